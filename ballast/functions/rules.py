"""The combination rules, each as its own boolean column: True keeps.

Static rules look at the combination alone. Dynamic ones take a context of draws, given as
columns: masks of the last ten draws, newest first, and the mask of balls whose omission is
over 15.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.schema import RED_MAX

R = fb.cols
mask = lambda: F.col("mask")


def _sum():
    return fb.total(R())


def _among(test) -> Column:
    """How many balls satisfy ``test``: one AND and one bit count, whatever the test."""
    return F.bit_count(mask().bitwiseAND(F.lit(sum(1 << b for b in range(1, RED_MAX + 1) if test(b)))))


def _with_next(k: int) -> Column:
    """Balls n of the mask for which n + 1 .. n + k are in it too."""
    return reduce(lambda a, i: a.bitwiseAND(F.shiftright(mask(), i)), range(1, k + 1), mask())


def _runs() -> Column:
    """Runs of two or more: balls with the next one and without the one before."""
    return F.bit_count(_with_next(1).bitwiseAND(F.bitwise_not(F.shiftleft(mask(), 1))))


STATIC = {
    "r1_not_regular": lambda: fb.distinct_gaps() > 1,
    "r2_sum": lambda: _sum().between(70, 160),
    "r3_span": lambda: F.col("b6") - F.col("b1") >= 15,
    "r4_runs": lambda: (_runs() < 3) & (_with_next(3) == 0),
    "r5_zones": lambda: (_among(lambda b: b <= 11) < 6) & (_among(lambda b: 12 <= b <= 22) < 6) & (_among(lambda b: b >= 23) < 6),
    "r6_ac": lambda: (fb.distinct_differences() - 5).between(6, 10),
    "r7_primes": lambda: _among(lambda b: b in (1, *fb.PRIMES)).between(2, 4),
    "r8_big_small": lambda: _among(lambda b: b <= 16).between(2, 4),
    "r11_odd_even": lambda: _among(lambda b: b % 2 == 0).between(2, 4),
    "r12_mod3": lambda: (_among(lambda b: b % 3 == 0) > 0) & (_among(lambda b: b % 3 == 1) > 0) & (_among(lambda b: b % 3 == 2) > 0),
    # six balls of which no three share a tail have three tails at least
    "r13_tails": lambda: ~fb.tail_thrice(F.col("tails")),
    "r14_head_tail": lambda: (F.col("b1") <= 10) & (F.col("b6") >= 25),
    "r15_tail_sum": lambda: fb.total(b % 10 for b in R()).between(15, 45),
}
#: Defined, but in no chain by default.
OFF = ("r7_primes",)
#: r14 implies r3 and r5, the bounds of r6 imply r1, and r7 is off: the same survivors from nine.
FAST = ("r2_sum", "r4_runs", "r6_ac", "r8_big_small", "r11_odd_even", "r12_mod3", "r13_tails", "r14_head_tail", "r15_tail_sum")

def recent_overlap(recent: list[Column]) -> Column:
    """R9: shares fewer than four balls with each recent draw."""
    return reduce(lambda a, b: a & b, (F.coalesce(fb.hits(mask(), m), F.lit(0)) < 4 for m in recent))


def not_all_cold(cold: Column) -> Column:
    """R10: not all six have been missing for more than 15 draws."""
    return fb.hits(mask(), cold) < 6


def related(last: Column) -> Column:
    """R16: some ball is one of the last draw's, or next to one."""
    near = last.bitwiseOR(F.shiftleft(last, 1)).bitwiseOR(F.shiftright(last, 1))
    return mask().bitwiseAND(near) != 0


def no_diagonal(last: Column, before: Column) -> Column:
    """R17: no ball n with n - 1 in the last draw and n - 2 in the one before."""
    return mask().bitwiseAND(F.shiftleft(last, 1)).bitwiseAND(F.shiftleft(before, 2)) == 0


def not_rejected(seed: Column, per_mille: int = 363) -> Column:
    """RX: an arithmetic draw by mask and seed, the same on every engine and partitioning."""
    return (mask() * 7919 + seed * 104729) % 1000003 % 1000 >= per_mille


def static_keep(names=FAST) -> Column:
    return reduce(lambda a, b: a & b, (STATIC[n]() for n in names))
