"""A stored table in key ranges that a merge rewrites only where something changes.

    root/parts/<uuid>/part=<k>/*.parquet    rows of one range, sorted by key; never changed once written
    root/versions/<number>                  one small text file a version: its ranges and their folders

A version is published by renaming its file to the next number, which fails where another writer
was first; readers take the greatest number. So a reader sees a whole version or the one before, a
failed merge leaves only folders that no version names, and a merge that changes nothing publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.operators.ingest import keep_last
from ballast.sources.files import _hadoop, delete, exists, materialised

#: Rows of a range when it is written; a range that has grown to twice as many is cut anew.
RANGE_ROWS = 1 << 20


@dataclass(frozen=True)
class Range:
    low: str | None  #: least key that belongs here, as text; None for the first range
    folder: str
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    ranges: list[Range]  #: in key order; they cover all keys
    schema: str

    def read(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.schema))
        return spark.read.schema(schema).parquet(*(r.folder for r in self.ranges)) if self.ranges else spark.createDataFrame([], schema)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    p, fs = _hadoop(spark, f"{root}/versions")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The version of that number, the newest where none is given; None of an empty store."""
    numbers = _numbers(spark, root)
    if not numbers or number is not None and number not in numbers:
        return None
    number = numbers[-1] if number is None else number
    found = json.loads(spark.read.text(f"{root}/versions/{number:012d}", wholetext=True).first()[0])
    return Version(number, [Range(**r) for r in found["ranges"]], found["schema"])


def _publish(spark: SparkSession, root: str, ranges: list[Range], schema: str, number: int) -> Version:
    text = json.dumps({"ranges": [asdict(r) for r in ranges], "schema": schema}, ensure_ascii=False, indent=1)
    part, fs = _hadoop(spark, f"{root}/versions/.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    to, _ = _hadoop(spark, f"{root}/versions/{number:012d}")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = jvm.FileContext.getFileContext(to.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    try:
        files.rename(part, to, none)  # without OVERWRITE: fails if the number is taken
    except Exception:
        fs.delete(part, False)
        raise
    return Version(number, ranges, schema)


def _range_of(key: Column, lows: list[str | None]) -> Column:
    """The index of the range that a key belongs to: how many ranges after the first begin at or before it, by binary search in one array."""
    n = len(lows)
    if n < 2:
        return F.lit(0)
    # range 0 takes what is before all others; halving steps, each taken where it does not overshoot
    begins, halves = F.array(*(F.lit(x) for x in lows[1:])), F.array(*(F.lit(1 << i) for i in reversed(range((n - 1).bit_length()))))
    # past the end there is null, which is not reached
    return F.aggregate(halves, F.lit(0), lambda at, by: F.when(F.get(begins, at + by - 1) <= key, at + by).otherwise(at))


def merge(spark: SparkSession, root: str, new: DataFrame, key: str, order: list[str], range_rows: int = RANGE_ROWS) -> Version | None:
    """Merges rows into the store: the last of each key by ``order`` replaces what is stored under it, whole. Returns the newest version.

    new: the stored columns and those of ``order``; keys are strings, ordered as Spark orders strings. Only ranges that some row
    changes are rewritten, each into a new folder; all others keep their files. Where no row
    differs from what is stored the version stays as it is. Rows with a null key are left out.
    """
    was = version(spark, root)
    fresh = keep_last(new.where(F.col(key).isNotNull()), [key], [F.col(c) for c in order])
    columns = [c for c in new.columns if c not in order]
    fresh = fresh.select(columns)
    if was is None:
        if fresh.isEmpty():
            return None
        return _publish(spark, root, _written(spark, root, fresh, key, range_rows), fresh.schema.json(), 1)
    lows = [r.low for r in was.ranges]
    placed = materialised(spark, fresh.withColumn("_range", _range_of(F.col(key), lows)), "merge-new")
    touched = sorted(r[0] for r in placed.select("_range").distinct().collect())  # a row a range
    if not touched:
        return was
    old = Version(was.number, [was.ranges[i] for i in touched], was.schema).read(spark).select(columns)
    # a row that is stored already changes nothing
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    news = placed.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left").where(F.col(f"o.{key}").isNull() | ~same)
    news = materialised(spark, news.select(*(F.col(f"n.{c}").alias(c) for c in columns), F.col("n._range").alias("_range")), "merge-changes")
    changed = sorted(r[0] for r in news.select("_range").distinct().collect())
    if not changed:
        return was
    stale = Version(was.number, [was.ranges[i] for i in changed], was.schema).read(spark).select(columns)
    rest = stale.join(news.select(key), key, "left_anti").select(columns).withColumn("_range", _range_of(F.col(key), lows))
    made = _rewritten(spark, root, news.unionByName(rest), key, columns, {i: was.ranges[i].low for i in changed}, range_rows)
    ranges = [x for i, r in enumerate(was.ranges) for x in made.get(i, [r])]
    return _publish(spark, root, ranges, was.schema, was.number + 1)


def _written(spark: SparkSession, root: str, rows: DataFrame, key: str, range_rows: int) -> list[Range]:
    """All rows as new ranges of about ``range_rows``."""
    return _rewritten(spark, root, rows.withColumn("_range", F.lit(0)), key, rows.columns, {0: None}, range_rows)[0]


def _rewritten(spark: SparkSession, root: str, rows: DataFrame, key: str, columns: list[str], lows: dict[int, str | None], range_rows: int) -> dict[int, list[Range]]:
    """Ranges in place of each old one (by _range), whose first begins where that began; large ones are cut at quantiles of their keys."""
    rows = materialised(spark, rows, "merge-rows")
    sizes = {r._range: r.n for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row a range
    cuts: dict[int, list[str | None]] = {}
    for i, low in lows.items():
        cuts[i] = [low]
        if sizes.get(i, 0) >= 2 * range_rows:
            cuts[i] += _cut_keys(rows.where(F.col("_range") == i), key, -(-sizes[i] // range_rows))
    starts = [(i, low) for i in sorted(cuts) for low in cuts[i]]
    # ranges lie in key order and rows only in those of ``lows``, so what begins last at or before a key is its own
    place = _range_of(F.col(key), [low for _, low in starts])
    folder = f"{root}/parts/{uuid.uuid4().hex}"
    dealt = rows.withColumn("part", place).repartition(max(1, len(starts)), "part").sortWithinPartitions("part", key)
    dealt.select(*columns, "part").write.partitionBy("part").parquet(folder)
    counted = {r.part: r.n for r in spark.read.parquet(folder).groupBy("part").agg(F.count("*").alias("n")).collect()}
    out: dict[int, list[Range]] = {i: [] for i in lows}
    for k, (i, low) in enumerate(starts):
        if k in counted:  # keys of a part without rows belong to the one before it
            out[i].append(Range(low, f"{folder}/part={k}", counted[k]))
    return out


def _cut_keys(rows: DataFrame, key: str, parts: int) -> list[str]:
    """parts - 1 distinct keys at about equal ranks, by the ranges that Spark's sampling finds: one row a partition."""
    dealt = rows.select(key).repartitionByRange(parts, key)
    firsts = sorted(r.low for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low")).collect())
    return firsts[1:]


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes versions before the last ``keep`` and folders that no kept one names; returns how many folders went."""
    numbers = _numbers(spark, root)
    kept = [version(spark, root, n) for n in numbers[-keep:]]
    named = {r.folder.rsplit("/", 2)[-2] for v in kept for r in v.ranges}
    for n in numbers[:-keep]:
        delete(spark, f"{root}/versions/{n:012d}")
    if not exists(spark, f"{root}/parts"):
        return 0
    p, fs = _hadoop(spark, f"{root}/parts")
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in named]
    for x in gone:
        fs.delete(x, True)
    return len(gone)
