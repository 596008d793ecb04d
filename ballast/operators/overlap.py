"""Draws that share four or more balls, found by the sets of four that they hold.

Six balls have C(6, 4) = 15 subsets of four, and two draws share four balls exactly where they share
a subset; so the overlap join is an equi-join on subsets, and no draw is compared with one that it shares none with. A pair that shares five
or six balls meets under several subsets and is counted under one, that of its lowest four common
balls. Draws with the same balls are one node.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.functions.scan import running_totals

SHARED = 4


def subsets(size: int = SHARED) -> Column:
    """The masks of all subsets of ``size`` of b1..b6."""
    return F.array(*(fb.mask_of([F.col(b) for b in some]) for some in combinations(fb.B, size)))


def lowest(mask: Column, n: int) -> Column:
    """The n lowest bits that are set."""
    out, rest = F.lit(0).cast("long"), mask
    for _ in range(n):
        low = rest.bitwiseAND(-rest)
        out, rest = out.bitwiseOR(low), rest.bitwiseAND(rest - 1)
    return out


def neighbours(sets: DataFrame) -> DataFrame:
    """(mask, other, shared): of distinct combinations (b1..b6, mask), those that share at least four balls, each with itself too.

    A subset of four is in C(29, 2) = 406 combinations, so however many draws there are, a key has at most as many rows a side.
    """
    each = sets.select("mask", F.explode(subsets()).alias("key"))
    pairs = each.join(each.withColumnRenamed("mask", "other"), "key")
    # computed once, as a generator's row
    both = pairs.select("*", F.explode(F.array(F.col("mask").bitwiseAND(F.col("other")))).alias("common"))
    return both.where(F.col("key") == lowest(F.col("common"), SHARED)).select("mask", "other", F.bit_count("common").alias("shared"))


def earlier_overlaps(draws: DataFrame) -> DataFrame:
    """(idx, n, last): how many draws before each share four balls or more with it, and the latest of them (null where none).

    draws: idx, b1..b6, mask. An event a draw and neighbour of its balls, and one running count over the positions: the
    work follows draws x neighbours that occur (at most 5,428 of them), not pairs of draws.
    """
    near = neighbours(draws.select(*fb.B, "mask").distinct())
    events = draws.select("idx", F.col("mask").alias("other")).join(near.select("mask", "other"), "other").select("mask", "idx", F.lit(1.0).alias("weight"))
    out = running_totals(events, draws.select("mask", F.col("idx").alias("step")), ["mask"])
    return out.select(F.col("step").alias("idx"), F.col("total").cast("long").alias("n"), "last")


def without_overlap(combos: DataFrame, draws: DataFrame) -> DataFrame:
    """Combinations (b1..b6, mask) that share fewer than four balls with every one of the draws: rule R9 against any number of draws, as an anti join.

    The draws' subsets are at most C(33, 4) = 40,920 rows, so they are broadcast.
    """
    taken = draws.select(F.explode(subsets()).alias("key")).distinct()
    met = combos.select("mask", F.explode(subsets()).alias("key")).join(F.broadcast(taken), "key", "left_semi").select("mask").distinct()
    return combos.join(met, "mask", "left_anti")
