"""A training-corpus pipeline: five stages, each one operator, each written before the next reads it.

Stages take (spark, docs, sf_dir) and return the columns of ``docs``, except the last, which
returns packed pieces. Each works on all rows that its predecessor kept. What a stage does
with nulls, empty texts, ties and repeated rows is its operator's rule:

toxicity      drops documents that score 0.5 or more; null and empty texts score as clean.
near_dup      keeps the least doc_id of each group linked at a Jaccard similarity of 0.8 on five-word
              shingles; empty texts and null doc_ids are linked to nothing and stay. Rows that share
              a doc_id are one document, linked to whatever any of their texts is, and stay or go
              together; so a row that is there twice under one doc_id is still there twice.
repeats       cuts words that lie in a 50-word window of a document with a smaller doc_id, from each
              text of a doc_id by itself; a
              document left empty goes, one that loses nothing keeps its text unchanged.
              n_chars follows the text.
benchmark     drops documents that hold a benchmark item within its edit budget.
packing       packs what is left into sequences of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontaminate, near_dup, packing, repeats, toxicity
from ballast.llm._shared import drop_written, results_dropped, table, written
from ballast.llm.queries import _tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return toxicity.drop_toxic(spark, docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels"), train))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.near_duplicates(spark, docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(spark, docs, window=50)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, _tokenizer(), capacity=4096, end_id=2)


STAGES = [("toxicity", toxicity_stage), ("near_dup", near_dup_stage), ("repeats", repeats_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: Word-piece encoding, the grammar and the cost-balanced packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with results_dropped(spark):
            docs = written(spark, stage(spark, before, sf_dir), f"pipeline-{name}")
        drop_written(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
