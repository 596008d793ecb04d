"""Draw records: typing, positions on the whole history, features and lags.

Positions and lags don't need the history in one task: rows are dealt out by ranges of the key,
a small table of range sizes gives each range's first position, and a lag's reach is had by
copying the last rows of a chunk of positions to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.schema import BLUE_MAX, PICK, RED_MAX, WARM_UP, WINDOW
from ballast.sources.files import materialised

CHUNK = 1 << 16


def with_positions(df: DataFrame, key: str, name: str = "idx", ties: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of each row by ``key``, equal keys by ``ties``; null keys come first. The result is a table in the shared folder.

    Rows are dealt out in ranges that Spark cuts at sampled quantiles of the keys, so partitions are of about one
    size however the keys lie: a stray key or a dense stretch moves the cuts and no more. Rows that
    agree in key and ties are parted by where they were read. A row's position is the number of rows in
    the partitions before its own, a table of one row a partition, and its place in there.
    """
    dealt = df.withColumn("_read", F.monotonically_increasing_id())
    order = [key, *ties, "_read"]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("_read")
    # written, as a second run could draw another sample
    placed = materialised(df.sparkSession, dealt.withColumn("_place", F.monotonically_increasing_id()), "positions")
    placed = placed.select(*df.columns, *partition_and_place("_place"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))


def partition_and_place(column: str) -> tuple[Column, Column]:
    """The parts of a monotonically increasing id: the partition, _part, and the row in it, _row."""
    return F.shiftright(column, 33).alias("_part"), F.col(column).bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")


def with_lags(df: DataFrame, columns: dict[str, Column], reach: int, idx: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Adds window expressions that look at most ``reach`` rows back; each is given the window by ``over``."""
    own = df.withColumn("_chunk", F.floor(F.col(idx) / chunk)).withColumn("_halo", F.lit(False))
    tail = own.where(F.col(idx) % chunk >= chunk - reach).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True))
    w = Window.partitionBy("_chunk").orderBy(idx)
    out = own.unionByName(tail)
    out = out.select("*", *(make(w).alias(n) for n, make in columns.items()))
    return out.where("NOT _halo").drop("_chunk", "_halo")


def with_previous(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(idx, b1..b6, blue) and ``features`` of the draw before, as a table in the shared folder; draws before WARM_UP precede none.

    A draw is one integer while neighbours meet, and meets them inside a chunk of positions: one narrow shuffle, no join.
    """
    fields, bits = [*fb.B, "blue"], 6
    unpacked = lambda c: [F.shiftright(c, i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(b) for i, b in enumerate(fields)]
    packed = fb.either(F.shiftleft(F.col(b).cast("long"), i * bits) for i, b in enumerate(fields))
    near = with_lags(df.select("idx", packed.alias("_draw")), {"_before": lag1("_draw")}, 1).where(F.col("idx") > WARM_UP)
    near = near.select("idx", "_draw", *unpacked("_before")).select("idx", "_draw", *(c.alias(n) for n, c in features.items()))
    return materialised(df.sparkSession, near.select("idx", *unpacked("_draw"), *features), "followed")


def moving_mean(column: str, size: int = WINDOW):
    """Mean of the previous ``size`` rows, null until there are as many."""

    def over(w):
        frame = w.rowsBetween(-size, -1)
        return F.when(F.count(column).over(frame) == size, F.avg(column).over(frame))

    return over


def lag1(column: str):
    return lambda w: F.lag(column).over(w)


def _once(c: Column) -> Column:
    """c as a generator's only row: computed once, where a plain column is repeated in each expression that uses it."""
    return F.explode(F.array(c))


def wide(df: DataFrame) -> DataFrame:
    """issue, reds (array), blue and more -> b1..b6 ascending, and their mask; other columns stay."""
    out = df.select(*(c for c in df.columns if c != "reds"), _once(F.sort_array("reds")).alias("reds"))
    out = out.select("*", *(F.get("reds", F.lit(i)).cast("int").alias(fb.B[i]) for i in range(PICK)))
    return out.withColumn("mask", fb.mask_of(fb.cols()))


def draws_from_orders(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A draw an order, by arithmetic on its keys: the engine's test history at any scale. keep: further columns that stay.

    The six balls with the least of a mixing value, found inside the row; keys are not negative.
    """
    base = orders.select("o_orderkey", "o_custkey", "o_orderdate", *keep, ((F.col("o_orderkey") + 1) * 7919 % 10007).cast("int").alias("_a"), (F.col("o_custkey") % 97 * 31).cast("int").alias("_c"))
    # value and ball in one integer, so that plain integers are sorted; few to a step, as the
    # virtual machine compiles only methods that are not too long
    key = lambda b: F.coalesce((F.col("_a") + b * 104729 % 10007 + F.col("_c") * (b * b)) % 10007 * 64 + b, F.lit(0))
    parts = {f"_k{i}": F.array(*(key(b) for b in range(i, min(i + PICK, RED_MAX + 1)))) for i in range(1, RED_MAX + 1, PICK)}
    for name, part in parts.items():
        base = base.select("*", _once(part).alias(name))
    ranked = base.select("*", _once(F.sort_array(F.concat(*parts))).alias("_keys"))
    reds = F.sort_array(F.array(*((F.get("_keys", F.lit(i)) % 64) for i in range(PICK))))
    blue = (F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % BLUE_MAX + 1
    return wide(ranked.select(*keep, F.col("o_orderkey").alias("issue"), F.to_date("o_orderdate").alias("draw_date"), reds.alias("reds"), blue.cast("int").alias("blue")))



STATIC_FEATURES = {
    "red_sum": lambda: fb.total(fb.cols()),
    "red_span": lambda: F.col("b6") - F.col("b1"),
    "odd_count": fb.odd_count,
    "red_zone_small": lambda: fb.between(1, 11),
    "red_zone_medium": lambda: fb.between(12, 22),
    "red_zone_large": lambda: fb.between(23, 33),
    "red_big_count": lambda: fb.count_where(lambda b: b > 16),
    "red_prime_count": lambda: fb.count_where(lambda b: b.isin(*fb.PRIMES)),
    "red_sum_tail": lambda: fb.total(fb.cols()) % 10,
    "red_consecutive_groups": fb.run_groups,
    "red_ac_value": fb.distinct_differences,
    "red_tail_uniques": lambda: fb.distinct_mod(10),
}
WINDOW_FEATURES = {
    "blue_lag1": lag1("blue"), "red_sum_lag1": lag1("red_sum"), "odd_count_lag1": lag1("odd_count"),
    "red_sum_ma5": moving_mean("red_sum"), "odd_count_ma5": moving_mean("odd_count"), "blue_ma5": moving_mean("blue"),
}
#: In the order in which a model takes them.
FEATURES = [
    "red_sum", "red_span", "odd_count", "blue_lag1", "red_zone_small", "red_zone_medium", "red_zone_large", "red_big_count", "red_prime_count", "red_sum_tail",
    "red_consecutive_groups", "red_ac_value", "red_tail_uniques", "red_sum_lag1", "odd_count_lag1", "red_sum_ma5", "odd_count_ma5", "blue_ma5",
]


def static_features(draws: DataFrame) -> DataFrame:
    return draws.select("*", *(f().cast("long").alias(n) for n, f in STATIC_FEATURES.items()))


def features(draws: DataFrame) -> DataFrame:
    """All 18 features of draws that have positions."""
    return with_lags(static_features(draws), WINDOW_FEATURES, WINDOW)


def next_labels(draws: DataFrame) -> DataFrame:
    """issue, and the mask and blue of the next draw (null for the last): whether ball b comes next is a bit."""
    ahead = draws.select((F.col("idx") - 1).alias("idx"), F.col("mask").alias("next_mask"), F.col("blue").alias("next_blue"))
    return draws.join(ahead, "idx", "left").select("idx", "issue", "next_mask", "next_blue")


def mean_filled(rows: DataFrame, feats: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (issue, columns), null features replaced by their means over ``feats``, which are one row."""
    means = feats.agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return rows.crossJoin(F.broadcast(means)).select("issue", *(F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) for c in columns))


def last_row_filled(feats: DataFrame, columns: list[str]) -> DataFrame:
    """The last row, its null features replaced by the history's means."""
    return mean_filled(feats.orderBy(F.desc("idx")).limit(1), feats, columns)
