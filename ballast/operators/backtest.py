"""Walk-forward backtest: all steps in one plan, keyed by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import rules
from ballast.operators import combos, scoring, settle
from ballast.schema import BACKTEST_STEPS, MIN_HISTORY, Params
from ballast.sources.files import materialised


def backtest(spark: SparkSession, draws: DataFrame, params: Params, n: int, periods: int = BACKTEST_STEPS, scorer=None, seed: int | None = 42, names=rules.FAST) -> DataFrame | None:
    """Settled bets of the last ``periods`` draws, each chosen from the draws before it; None where the history of ``n`` draws is too short."""
    if n < periods + MIN_HISTORY:
        return None
    first, last = n - periods, n - 1
    # 49 rows a step each, and read by several branches of the plan
    stats = materialised(spark, scoring.ball_stats(spark, draws, params.decay_factor, first, last), "stats")
    probs = (scorer or scoring.SqlScorer()).probabilities(spark, draws, first, last)
    rank = materialised(spark, scoring.ranked(scoring.scores(stats, probs, params)), "rank")
    kept = combos.passed_of_pool(scoring.red_pool(rank), combos.context(draws, stats), seed, names)
    top_blue = scoring.blue_pool(rank, 1).select("step", F.col("ball").alias("blue"))
    bets = kept.join(F.broadcast(top_blue), "step")  # a row a step
    results = draws.where((F.col("idx") >= first) & (F.col("idx") <= last)).select(F.col("idx").alias("step"), "mask", "blue")
    return settle.settle_single(bets, results, on="step")
