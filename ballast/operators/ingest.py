"""Precedence union and keep-last upsert of raw draw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``, whole.

    As an aggregate: the greatest struct of order and row is kept map-side, so a key with any
    number of versions costs one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = [F.struct(*order).alias("_order")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def precedence_union(*sources: DataFrame) -> DataFrame:
    """Rows of all sources with their priority; later sources win whole rows. Missing columns are null."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, html: DataFrame, text: DataFrame) -> DataFrame:
    """Text over HTML over existing rows, by issue (a string here); seq orders rows within a source.

    A row replaces another whole: an HTML row, which has no date, takes the date away.
    """
    return keep_last(precedence_union(existing, html, text), ["issue"], ["priority", "seq"]).drop("priority", "seq")
