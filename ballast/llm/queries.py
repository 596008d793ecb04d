"""The corpus operators' registered queries: thin digests of each operator's own result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import align, chat, decontaminate, filter_audit, maxent, near_dup, oracle, packing, quality, repeats, token_counts, token_files, toxicity, url_filter
from ballast.llm._shared import table


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pigeonhole_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT CAST(-7 AS BIGINT) AS conv_id, t.* FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(said))
    back = chat.read_back(chat.format_conversations(given.unionByName(more)))
    turns = F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n")))
    # windows of a conversation meet once more, as the digest is of the conversation as a whole
    parts = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), F.array_join(turns, "").alias("turns"), F.array_join("targets", "").alias("loss"), "chars").alias("w"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    joined = lambda name: F.array_join(F.col(f"w.{name}"), "")
    total = lambda name: F.aggregate(F.col(f"w.{name}"), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.select(
        "conv_id", total("n").alias("n_turns"), F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"),
    )


def op3_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer(), capacity=4096, end_id=2)


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_shards(spark, table(spark, sf_dir, "documents"), _tokenizer(), end_id=2)
    return token_files.read_shards(manifest).drop("shard")


def op6_hashed_maximum_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(spark, table(spark, sf_dir, "documents"))


def op7_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(spark, table(spark, sf_dir, "documents"), window=50)


def op8_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = toxicity.score_documents(spark, docs, model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="first")


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(spark, table(spark, sf_dir, "documents"))


#: The rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_sorted_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(spark, pages, rules, url_filter.listed_hosts(pages)).drop("listed")


def op12_both_end_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(spark, table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
