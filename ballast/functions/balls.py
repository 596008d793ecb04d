"""Column expressions over a draw or combination held as b1 < ... < b6 and as a bit mask.

Scalars and bit arithmetic stay inside generated code, where arrays and lambdas do not.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.schema import PICK

B = [f"b{i}" for i in range(1, PICK + 1)]
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31)


def cols() -> list[Column]:
    return [F.col(b) for b in B]


def total(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def either(xs) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), xs)


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def count_where(test) -> Column:
    return total(F.when(test(b), 1).otherwise(0) for b in cols())


def mask_of(balls: list[Column]) -> Column:
    """Bit n set for ball n."""
    return either(bit(b) for b in balls)


def mask_from_array(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(bit(b)))


def hits(a: Column, b: Column) -> Column:
    """Balls that two masks share."""
    return F.bit_count(a.bitwiseAND(b))


def odd_count() -> Column:
    return count_where(lambda b: b % 2 == 1)


def between(lo: int, hi: int) -> Column:
    return count_where(lambda b: b.between(lo, hi))


def run_groups() -> Column:
    """Maximal runs of at least two consecutive balls."""
    b = cols()
    starts = []
    for i in range(PICK - 1):
        begins = b[i + 1] - b[i] == 1
        starts.append(F.when(begins if i == 0 else begins & (b[i] - b[i - 1] != 1), 1).otherwise(0))
    return total(starts)


def run_of_four() -> Column:
    b = cols()
    return reduce(lambda x, y: x | y, (b[i + 3] - b[i] == 3 for i in range(PICK - 3)))


def distinct_differences() -> Column:
    return F.bit_count(either(bit(y - x) for x, y in combinations(cols(), 2)))


def distinct_gaps() -> Column:
    b = cols()
    return F.bit_count(either(bit(b[i + 1] - b[i]) for i in range(PICK - 1)))


def distinct_mod(k: int) -> Column:
    return F.bit_count(either(bit(b % k) for b in cols()))


def tail_counters() -> Column:
    """Ten 4-bit counters of ending digits in one integer."""
    return total(bit((b % 10) * 4) for b in cols())


def tail_thrice(counters: Column) -> Column:
    """Whether some 4-bit counter is 3 or more."""
    low, two = 0x1111111111, 0x2222222222
    high = counters.bitwiseAND(F.lit(0xCCCCCCCCCC))
    three = F.shiftright(counters.bitwiseAND(F.lit(two)), 1).bitwiseAND(counters.bitwiseAND(F.lit(low)))
    return (high != 0) | (three != 0)
