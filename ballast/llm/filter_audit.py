"""What each filter of a chain takes away, in every order in which the chain could run.

A direct relational replay. Each document has one flag a filter, whether it fails it, found
on the whole text alone or on the whole table. Flag vectors meet a broadcast table of all orders
(120 of five filters), each pair is exploded into its steps, the first failing step
follows from the flags, and a conditional aggregate by part, order and step counts what
happened there. Documents of one part with the same flags and labels fare alike, so they are combined
before they meet the orders, as a map-side combine would after: the rows replayed are at most
parts x 2^filters x label values, whatever the number of documents.

The five filters, true where a document fails (words: runs of bytes other than 0x20, 0x09-0x0D):

    A  under 50 words
    B  100 * distinct words < 65 * words
    C  100 * letters A-Z > 5 * code points
    D  any of # $ % & * |
    E  the text of some document with a smaller doc_id, removed or not
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_BREAKS = "[\\x20\\x09-\\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Filters A to D of a text that is not null."""
    words = F.filter(F.split(text, _BREAKS), lambda w: w != "")
    size = lambda c: F.size(c).cast("long")
    # the words are computed once a row, as a lambda's argument
    few = lambda w: F.struct((size(w) < 50).alias("A"), (100 * size(F.array_distinct(w)) < 65 * size(w)).alias("B"))
    ab = F.get(F.transform(F.array(words), few), F.lit(0))
    capitals = F.length(text).cast("long") - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": ab["A"], "B": ab["B"], "C": 100 * capitals > 5 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic, n): how many documents have these. flags: bit i is set where filter i fails.

    The least doc_id of each text comes from an aggregate by a 256-bit digest, and goes back to the one document that it names,
    not to all copies of the text; so neither a text with any number of copies nor a
    source with any share of the rows meets in one task. Labels count by doc_id: a document is
    good (toxic) where any of its label rows says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.explode(F.array(text)).alias("text"))
    own = text_flags(F.col("text"))
    bits = reduce(lambda a, b: a + b, (F.when(own[k], 1 << i).otherwise(0) for i, k in enumerate(FILTERS[:-1])))
    # rows that are there twice are one row from here on
    rows = base.select("doc_id", "part", bits.alias("own"), F.sha2("text", 256).alias("digest")).groupBy("doc_id", "part", "own", "digest").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    fields = ["part", (F.col("own") + F.when(F.col("is_first"), 0).otherwise(1 << 4)).alias("flags"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n"]
    # no doc_id is smaller than any, larger than any or labelled
    nameless = rows.where("doc_id IS NULL").select("part", F.col("own").alias("flags"), F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return known.select(*fields).unionByName(nameless).groupBy("part", "flags", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(filter_order, bits): every order and the flag bit of each of its steps; factorial(filters) rows, 120 for five."""
    rows = [("".join(p), [1 << filters.index(x) for x in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flagged: DataFrame, every_order: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), from document_flags() and orders().

    A row a part, order and step, zeros included. shapley sums a filter's removals over all
    orders of the part; divided by their number it is the filter's Shapley value.
    """
    met = flagged.crossJoin(F.broadcast(every_order))
    fails = F.transform("bits", lambda b: F.col("flags").bitwiseAND(b) != 0)
    met = met.withColumn("first", F.coalesce(F.nullif(F.array_position(fails, True), F.lit(0)), F.lit(99)).cast("int"))
    steps = met.select("part", "filter_order", "flags", "good", "toxic", "n", "first", F.posexplode("bits").alias("at", "bit"))
    step = F.col("at") + 1
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0).cast("long")))
    here = F.col("first") == step
    counts = steps.groupBy("part", "filter_order", step.cast("int").alias("step"), "bit").agg(
        total(F.col("first") > step).alias("kept"), total(here).alias("removed"),
        total((F.col("flags").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < step)).alias("redundant"),
        total(F.col("flags") == F.col("bit")).alias("unique_fails"), total(here & (F.col("good") == 1)).alias("good_lost"), total(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    # a row an order and part: 120 rows to a window
    worth = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return counts.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", worth.alias("shapley"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """replay() of ``docs`` (doc_id, text, source) under ``labels`` (doc_id, quality, toxic).

    Null texts are empty; null sources are the part ''. An empty text fails A alone, and E as copies of it do.
    A null doc_id has no smaller one, is smaller than none and has no labels. Rows that are there twice count twice,
    and do not make each other fail E, having one doc_id; under one doc_id texts are judged one by one. A text of any length is one row's work.
    Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    return replay(document_flags(docs, labels), orders(spark))
