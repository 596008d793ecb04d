"""Settlement of single and multi-number bets against draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.schema import COST, NO_PRIZE, PICK, combinations_dim, prize_rules


#: Most rows that are broadcast where every bet meets every draw.
FEW = 100_000


def _met(bets: DataFrame, draws: DataFrame, on: str | None) -> DataFrame:
    """bets with the draws' win_mask and win_blue, paired by ``on``; without, every bet with every draw given.

    Draws grow with the history, so then the bets are broadcast, after their number is
    known to be few; more bets meet the draws partition by partition.
    """
    d = draws.select(F.col("mask").alias("win_mask"), F.col("blue").alias("win_blue"), *([F.col(on)] if on else []))
    if on:
        return bets.join(d, on)
    few = bets.limit(FEW + 1).count() <= FEW
    return d.crossJoin(F.broadcast(bets) if few else bets).select(*bets.columns, "win_mask", "win_blue")


def hits(bets: DataFrame, draws: DataFrame, on: str | None = None) -> DataFrame:
    """bets (mask, blue and more) x draws (mask, blue) with red_hits and blue_hit. ``on`` pairs them; without, every bet meets every draw given."""
    both = _met(bets, draws, on)
    return both.withColumn("red_hits", fb.hits(F.col("mask"), F.col("win_mask")).cast("int")).withColumn("blue_hit", (F.col("blue") == F.col("win_blue")).cast("int"))


def hit_counts(bets: DataFrame, draws: DataFrame) -> DataFrame:
    """(red_hits, blue_hit, n): how often every bet meeting every draw gives so many hits.

    Equal bets and equal draws (mask, blue) are counted before they meet, so the pairs are those of different ones, however long the
    history is: there are C(33, 6) x 16 different draws.
    """
    own = bets.groupBy("mask", "blue").agg(F.count("*").alias("n_bets"))
    won = draws.groupBy("mask", "blue").agg(F.count("*").alias("n_draws")).select(F.col("mask").alias("win_mask"), F.col("blue").alias("win_blue"), "n_draws")
    few = own.limit(FEW + 1).count() <= FEW
    both = won.crossJoin(F.broadcast(own) if few else own)
    return both.groupBy(fb.hits(F.col("mask"), F.col("win_mask")).cast("int").alias("red_hits"), (F.col("blue") == F.col("win_blue")).cast("int").alias("blue_hit")).agg(F.sum(F.col("n_bets") * F.col("n_draws")).alias("n"))


def settle_single(bets: DataFrame, draws: DataFrame, on: str | None = None) -> DataFrame:
    """hits() with prize, tier and a text."""
    return priced(hits(bets, draws, on))


def priced(rows: DataFrame) -> DataFrame:
    """Rows with red_hits and blue_hit, and their prize, tier, tier_rank and text."""
    out = rows.join(F.broadcast(prize_rules(rows.sparkSession)), ["red_hits", "blue_hit"], "left")
    return out.withColumn("prize", F.coalesce("prize", F.lit(0).cast("long"))).withColumn("tier", F.coalesce("tier", F.lit(NO_PRIZE))).withColumn("hit_text", F.format_string("命中%d+%d", "red_hits", "blue_hit"))


def settle_duplex(bets: DataFrame, draws: DataFrame, on: str | None = None, only_hit_blue: bool = True) -> DataFrame:
    """(bet columns, red_hits, blue_hits, tier, tier_rank, ways, prize): a row a tier that the rules reach.

    A tier with no combination is a row of its own with 0 ways (as for 4 hits and the blue with
    7 reds in the last tier). Counted are combinations with the winning blue if it was
    selected, else those without; ``only_hit_blue=False`` also counts each losing blue.
    """
    both = _met(bets, draws, on)
    red = fb.hits(F.col("mask"), F.col("win_mask")).cast("int")
    both = both.withColumn("red_hits", red).withColumn("misses", (F.bit_count("mask") - red).cast("int")).withColumn("blue_hits", F.array_contains("blues", F.col("win_blue")).cast("int"))
    rules = F.broadcast(prize_rules(bets.sparkSession).withColumnsRenamed({"red_hits": "r", "blue_hit": "b", "prize": "amount"}))
    same_blue = F.col("b") == F.col("blue_hits")
    pairs = both.join(rules, (F.col("r") <= F.col("red_hits")) & (same_blue if only_hit_blue else same_blue | (F.col("b") == 0)))
    c = F.broadcast(combinations_dim(bets.sparkSession))
    pairs = pairs.join(c.withColumnsRenamed({"n": "red_hits", "k": "r", "ways": "w1"}), ["red_hits", "r"])
    pairs = pairs.withColumn("k2", PICK - F.col("r")).join(c.withColumnsRenamed({"n": "misses", "k": "k2", "ways": "w2"}), ["misses", "k2"])
    times = F.lit(1) if only_hit_blue else F.when(same_blue & (F.col("b") == 1), 1).otherwise(F.size("blues") - F.col("blue_hits"))
    pairs = pairs.withColumn("ways", F.col("w1") * F.col("w2") * times)
    keys = [c for c in bets.columns] + ([on] if on and on not in bets.columns else [])
    return pairs.groupBy(*keys, "red_hits", "blue_hits", "tier", "tier_rank").agg(F.sum("ways").alias("ways"), F.sum(F.col("ways") * F.col("amount")).alias("prize"))


def prize_counts(settled: DataFrame) -> DataFrame:
    """(red_hits, blue_hit, n) of settled single bets that won."""
    return settled.where("prize > 0").groupBy("red_hits", "blue_hit").agg(F.count("*").alias("n"))


def tier_rollup(counts: DataFrame) -> DataFrame:
    """(tier, tier_rank, n): counts by name, only tiers that occur."""
    rules = F.broadcast(prize_rules(counts.sparkSession).select("red_hits", "blue_hit", "tier", "tier_rank"))
    return counts.join(rules, ["red_hits", "blue_hit"]).groupBy("tier", "tier_rank").agg(F.sum("n").alias("n"))


def profit(settled: DataFrame) -> DataFrame:
    """One row: bets, cost, winnings, profit."""
    out = settled.agg(F.count("*").alias("bets"), F.coalesce(F.sum("prize"), F.lit(0)).alias("winnings"))
    return out.select("bets", (F.col("bets") * COST).alias("cost"), F.col("winnings").cast("long").alias("winnings"), (F.col("winnings") - F.col("bets") * COST).cast("long").alias("profit"))
