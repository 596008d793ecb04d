"""Combinations as integers: rank and unrank, and a keyed permutation of all ranks.

The rank of b1 < ... < b6 is the sum of C(b_i - 1, i): 0 for 1..6, C(33, 6) - 1 for 28..33, each integer between for one
combination. A Feistel network over Z_899 x Z_1232, whose product is C(33, 6), permutes the ranks: each half is
moved by a function of the other, which can be taken back, whatever the function is. So the first n places of
a permutation are a sample of exactly n combinations without replacement, drawn one by one with no table of
all of them, and whether a combination is in the sample is arithmetic on itself.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.schema import PICK, RED_MAX

ALL = comb(RED_MAX, PICK)
LEFT, RIGHT = 899, 1232
ROUNDS = 4


def _choose(n: Column, k: int) -> Column:
    """C(n, k) for n of at least 0, exact in 64-bit integers as far as PICK balls of RED_MAX go."""
    top, bottom = n.cast("long"), 1
    for i in range(1, k):
        top, bottom = top * (n - i), bottom * (i + 1)
    return F.call_function("div", top, F.lit(bottom).cast("long")) if k > 1 else top


def rank(balls: list[Column] | None = None) -> Column:
    """The rank of a combination in ascending columns, b1..b6 where none are given."""
    return fb.total(_choose(b - 1, i) for i, b in enumerate(balls or fb.cols(), 1))


def unranked(df: DataFrame, column: str) -> DataFrame:
    """df with b1..b6 and mask of the rank in ``column``, which is from 0 to ALL - 1."""

    def greatest(left: Column, k: int, lo: int, hi: int) -> Column:
        """The ball b of lo..hi with the greatest C(b - 1, k) that is not over ``left``, and that number."""
        if lo == hi:
            return F.struct(F.lit(lo).alias("ball"), F.lit(comb(lo - 1, k)).cast("long").alias("worth"))
        mid = (lo + hi + 1) // 2
        return F.when(left >= comb(mid - 1, k), greatest(left, k, mid, hi)).otherwise(greatest(left, k, lo, mid - 1))

    out = df.withColumn("_left", F.col(column).cast("long"))
    for k in range(PICK, 0, -1):
        # a generator's only row: computed once, where a plain column would be repeated by all that use it
        out = out.select("*", F.explode(F.array(greatest(F.col("_left"), k, k, RED_MAX))).alias(f"_p{k}")).withColumn("_left", F.col("_left") - F.col(f"_p{k}.worth"))
    out = out.select(*df.columns, *(F.col(f"_p{k}.ball").alias(fb.B[k - 1]) for k in range(1, PICK + 1)))
    return out.withColumn("mask", fb.mask_of(fb.cols()))


def _moves(seed: int) -> list[int]:
    """A number a half-round."""
    return [(seed * 1009 + r * 7919 + 17) % 1000003 for r in range(2 * ROUNDS)]


def permuted(column: Column, seed: int, inverse: bool = False) -> Column:
    """The place-th rank of the permutation that ``seed`` names, or, inverse, the place of a rank."""
    f = lambda x, s, m: (x + s) * (x * 7919 + 104729 + s) % 1000003 % m
    by = lambda a, move, m: (a + (m - move if inverse else move)) % m
    moves = _moves(seed)
    pairs = [F.struct(F.lit(moves[r]).cast("long").alias("l"), F.lit(moves[r + 1]).cast("long").alias("r")) for r in range(0, 2 * ROUNDS, 2)]

    def step(at: Column, s: Column) -> Column:
        if inverse:
            right = by(at["r"], f(at["l"], s["r"], RIGHT), RIGHT)
            return F.struct(by(at["l"], f(right, s["l"], LEFT), LEFT).alias("l"), right.alias("r"))
        left = by(at["l"], f(at["r"], s["l"], LEFT), LEFT)
        return F.struct(left.alias("l"), by(at["r"], f(left, s["r"], RIGHT), RIGHT).alias("r"))

    place = column.cast("long")
    start = F.struct(F.call_function("div", place, F.lit(RIGHT).cast("long")).alias("l"), (place % RIGHT).alias("r"))
    return F.aggregate(F.array(*(pairs[::-1] if inverse else pairs)), start, step, lambda at: at["l"] * RIGHT + at["r"])


def sampled(spark: SparkSession, n: int, seed: int, first: int = 0) -> DataFrame:
    """(place, b1..b6, mask): n combinations without replacement, of places first..first + n - 1; n at most ALL in sum."""
    if not 0 <= first <= first + n <= ALL:
        raise ValueError(f"there are {ALL} combinations")
    ranks = spark.range(first, first + n).select(F.col("id").alias("place"), permuted(F.col("id"), seed).alias("_rank"))
    return unranked(ranks, "_rank").drop("_rank")


def not_sampled(n: int, seed: int) -> Column:
    """Whether b1..b6 are not among the first n places: the anti join with sampled(), without the join."""
    return permuted(rank(), seed, inverse=True) >= n


def distinct_of(draws: int) -> int:
    """How many different combinations so many draws with replacement are expected to give."""
    return round(ALL * (1 - (1 - 1 / ALL) ** draws))
