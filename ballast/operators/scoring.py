"""Decayed frequency, omission, probabilities, scores and pools, for any number of steps at once.

A step s sees the draws with idx < s. Frequencies, gaps and counts are running totals (functions.scan), so
what all steps need comes from one pass over the history, not from one a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.functions.scan import running_totals, slot_totals
from ballast.operators.draws import STATIC_FEATURES, with_previous
from ballast.schema import BLUE_MAX, DROPPED_REDS, NUM_BLUES, PICK, RED_MAX, WARM_UP, Params

#: Up to so many steps, a row a step and ball costs less to shuffle than two window columns a ball do to compile.
FEW_STEPS = 1000


def domain(spark: SparkSession) -> DataFrame:
    """(color, ball): 33 reds and 16 blues."""
    return spark.sql(f"SELECT 'red' AS color, explode(sequence(1, {RED_MAX})) AS ball UNION ALL SELECT 'blue', explode(sequence(1, {BLUE_MAX}))")


def drawn(draws: DataFrame, *keep: str) -> DataFrame:
    """(idx, keep, color, ball): a row a ball drawn."""
    ball = lambda color, c: F.struct(F.lit(color).alias("color"), F.col(c).cast("int").alias("ball"))
    return draws.select("idx", *keep, F.inline(F.array(*(ball("red", b) for b in fb.B), ball("blue", "blue"))))


def _drawn_bits(draws: DataFrame) -> DataFrame:
    """(idx, bits): a bit a ball drawn, reds first; a red that a draw has again is in a further row. Other numbers are no balls."""
    bit = lambda c, top, after=0: F.when(F.col(c).between(1, top), fb.bit(F.col(c) + (after - 1))).otherwise(F.lit(0).cast("long"))
    first = fb.either([*(bit(b, RED_MAX) for b in fb.B), bit("blue", BLUE_MAX, RED_MAX)])
    # reds ascend
    again = [fb.either(F.when(F.col(b) == F.col(a), bit(b, RED_MAX)).otherwise(F.lit(0).cast("long")) for a, b in zip(fb.B, fb.B[k:])) for k in range(1, PICK)]
    return draws.select("idx", F.explode(F.array(first, *again)).alias("bits")).where("bits != 0")


def grid(spark: SparkSession, first_step: int, last_step: int) -> DataFrame:
    """(step, color, ball): every ball at every step."""
    return spark.range(first_step, last_step + 1).select(F.col("id").alias("step")).crossJoin(F.broadcast(domain(spark)))


def ball_stats(spark: SparkSession, draws: DataFrame, decay: float, first_step: int, last_step: int) -> DataFrame:
    """(step, color, ball, freq, omission) for steps first_step..last_step; a ball not drawn yet has 0 and step."""
    if last_step - first_step < FEW_STEPS:
        out = running_totals(drawn(draws).withColumn("weight", F.lit(1.0)), grid(spark, first_step, last_step), ["color", "ball"], decay, steps=(first_step, last_step))
    else:
        slots = [F.struct(F.lit(c).alias("color"), F.lit(b).alias("ball")) for c, top in (("red", RED_MAX), ("blue", BLUE_MAX)) for b in range(1, top + 1)]
        out = slot_totals(_drawn_bits(draws), slots, (first_step, last_step), decay)
    omission = F.col("step") - F.coalesce("last", F.lit(-1)) - 1
    return out.select("step", "color", F.col("ball").cast("int").alias("ball"), F.col("total").alias("freq"), omission.cast("long").alias("omission"))


class SqlScorer:
    """Deterministic smoothed estimate: how often a ball followed a draw with as many odd reds as the last one has.

    (hits + 1) / (n + 2) over rows idx >= 5 with a known next draw. It takes the place of a learned
    model and its values are its own. Any object with this method can take its place.
    """

    def probabilities(self, spark: SparkSession, draws: DataFrame, first_step: int, last_step: int) -> DataFrame:
        """(step, color, ball, prob)."""
        odd = fb.odd_count().cast("int").alias("odd")
        # what followed, at the position where it became known
        followed = drawn(with_previous(draws, {"odd": odd}), "odd")
        last = draws.where(F.col("idx").between(first_step - 1, last_step - 1)).select((F.col("idx") + 1).alias("step"), odd)
        asked = last.crossJoin(F.broadcast(domain(spark)))
        hits = running_totals(followed.select("idx", "odd", "color", "ball", F.lit(1.0).alias("weight")), asked, ["odd", "color", "ball"], steps=(first_step, last_step))
        # each draw that followed has six reds, so their hits are six times the draws; 49 rows to a window
        n = F.sum(F.when(F.col("color") == "red", F.col("total"))).over(Window.partitionBy("step")) / PICK
        return hits.select("step", "color", F.col("ball").cast("int").alias("ball"), ((F.col("total") + 1) / (n + 2)).alias("prob"))


class BayesScorer:
    """Naive Bayes of each ball by the last draw's features, learned anew for every step from one pass over the history.

    What a step's model is made of are counts of the draws before it: how often the ball came next, and how often each feature
    value stood before it did and before it did not. All are running totals, so models for all steps come from
    the same scan; none is fitted. Counts are smoothed by one, and a feature has as many values as ``values`` says.
    """

    #: How many values each feature can take.
    VALUES = {"odd_count": 7, "red_zone_small": 7, "red_zone_medium": 7, "red_big_count": 7, "red_prime_count": 7, "red_sum_tail": 10, "red_consecutive_groups": 4, "red_tail_uniques": 6}

    def __init__(self, values: dict[str, int] | None = None):
        self.values = values or self.VALUES

    def probabilities(self, spark: SparkSession, draws: DataFrame, first_step: int, last_step: int) -> DataFrame:
        """(step, color, ball, prob)."""
        statics = {f: STATIC_FEATURES[f]().cast("long") for f in self.values}
        row = lambda f, value: F.struct(F.lit(f).alias("feature"), value.alias("value"), F.lit(self.values[f]).alias("values"))
        one, steps = F.lit(1.0).alias("weight"), (first_step, last_step)
        asked = draws.where(F.col("idx").between(first_step - 1, last_step - 1)).select((F.col("idx") + 1).alias("step"), F.inline(F.array(*(row(f, c) for f, c in statics.items()))))
        # what stood before, at the position where what followed became known
        followed = with_previous(draws, statics)
        each = F.inline(F.array(*(row(f, F.col(f)) for f in statics)))
        seen = running_totals(followed.select("idx", each).select("idx", "feature", "value", one), asked, ["feature", "value"], steps=steps).select("step", "feature", F.col("total").alias("n_value"))
        came = running_totals(drawn(draws).where(F.col("idx") > WARM_UP).select("idx", "color", "ball", one), grid(spark, first_step, last_step), ["color", "ball"], steps=steps)
        joint = drawn(followed, *statics).select("idx", "color", "ball", each).select("idx", "feature", "value", "color", "ball", one)
        both = running_totals(joint, asked.crossJoin(F.broadcast(domain(spark))), ["feature", "value", "color", "ball"], steps=steps).withColumnRenamed("total", "n_both").drop("last")
        rows = both.join(seen, ["step", "feature"]).join(came.withColumnRenamed("total", "n_came").drop("last"), ["step", "color", "ball"])
        n = F.greatest(F.col("step") - WARM_UP - 1, F.lit(0))
        side = F.log((F.col("n_both") + 1) / (F.col("n_came") + F.col("values"))) - F.log((F.col("n_value") - F.col("n_both") + 1) / (n - F.col("n_came") + F.col("values")))
        prior = F.log((F.col("n_came") + 1) / (n - F.col("n_came") + 1))
        odds = rows.groupBy("step", "color", "ball").agg((F.first(prior) + F.sum(side)).alias("odds"))
        return odds.select("step", "color", F.col("ball").cast("int").alias("ball"), (1 / (1 + F.exp(-F.col("odds")))).alias("prob"))


def scores(stats: DataFrame, probs: DataFrame, params: Params) -> DataFrame:
    """(step, color, ball, freq, omission, prob, score); a maximum of zero normalises as 1, a missing probability is 0."""
    w = Window.partitionBy("step", "color")  # at most 33 rows
    top = lambda c: F.coalesce(F.nullif(F.max(c).over(w), F.lit(0)), F.lit(1))
    out = stats.join(probs, ["step", "color", "ball"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    nf, no = F.col("freq") / top("freq"), F.col("omission") / top("omission")
    red = params.weight_freq * nf + params.weight_omission * no + params.weight_ml * F.col("prob")
    blue = params.weight_blue_freq * nf + params.weight_blue_ml * F.col("prob")
    return out.withColumn("score", F.round(F.when(F.col("color") == "red", red).otherwise(blue), 9))


def ranked(scored: DataFrame) -> DataFrame:
    """rn from 1 by descending score, ties by ball."""
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("step", "color").orderBy(F.desc("score"), "ball")))


def red_pool(rank: DataFrame, dropped: int = DROPPED_REDS) -> DataFrame:
    """What is left when the best ``dropped`` reds go: the contrarian pool."""
    return rank.where((F.col("color") == "red") & (F.col("rn") > dropped))


def blue_pool(rank: DataFrame, n: int = NUM_BLUES) -> DataFrame:
    return rank.where((F.col("color") == "blue") & (F.col("rn") <= n))
