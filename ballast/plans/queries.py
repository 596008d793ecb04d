"""The engine's registered queries: each operator over whole tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.functions import combinadic, rules
from ballast.operators import backtest, boosting, combos, draws, ingest, overlap, scoring, settle
from ballast.plans import runs
from ballast.plans.oracle import CLOCK
from ballast.schema import BACKTEST_STEPS, CSV_HEADER, REJECTED_DRAWS, TUNED, Params, prize_rules
from ballast.sources import files, markup, readers, reports, store


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with positions; these come first, on three plain columns."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return draws.draws_from_orders(draws.with_positions(orders, "o_orderkey"), ("idx",))


def kept_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The history as a table, for plans that read it in many branches, and its number of draws."""
    d = files.materialised(spark, history(spark, sf_dir).select("issue", "idx", "draw_date", *fb.B, "blue", "mask"), "draws")
    return d, d.count()


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def draws_wide(spark, sf_dir):
    d = history(spark, sf_dir)
    return d.select("issue", "idx", *(F.col(b).cast("long").alias(b) for b in fb.B), F.col("blue").cast("long").alias("blue"), "mask")


def draw_features_static(spark, sf_dir):
    d = history(spark, sf_dir)
    return draws.static_features(d).select("issue", *draws.STATIC_FEATURES)


def draw_features_window(spark, sf_dir):
    d = history(spark, sf_dir)
    return _rounded(draws.features(d).select("issue", *draws.WINDOW_FEATURES))


def _last(spark, sf_dir):
    d, n = kept_history(spark, sf_dir)
    return d, n, files.materialised(spark, scoring.ball_stats(spark, d, TUNED.decay_factor, n, n), "stats")


def ball_decayed_freq(spark, sf_dir):
    return _rounded(_last(spark, sf_dir)[2].where("color = 'red'").select("ball", "freq"))


def blue_decayed_freq(spark, sf_dir):
    return _rounded(_last(spark, sf_dir)[2].where("color = 'blue'").select("ball", "freq"))


def ball_omission(spark, sf_dir):
    return _rounded(_last(spark, sf_dir)[2].select("color", "ball", "omission"))


def _ranked(spark, sf_dir):
    d, n, stats = _last(spark, sf_dir)
    probs = scoring.SqlScorer().probabilities(spark, d, n, n)
    return d, n, stats, files.materialised(spark, scoring.ranked(scoring.scores(stats, probs, TUNED)), "rank")


def ball_stats_every_step(spark, sf_dir):
    """Decayed frequency and gap of each ball as every draw of the history, and the one to come, would have seen them."""
    d, n = kept_history(spark, sf_dir)
    return _rounded(scoring.ball_stats(spark, d, TUNED.decay_factor, 0, n))


def ball_score_rank(spark, sf_dir):
    return _rounded(_ranked(spark, sf_dir)[3].select("color", "ball", "score", "rn"))


def ball_split_gains(spark, sf_dir):
    """What every first split of a tree over all 49 balls would gain, after the whole history."""
    d, n = kept_history(spark, sf_dir)
    scorer = boosting.BoostScorer()
    _, rows, cuts = scorer.prepared(spark, d, n)
    return _rounded(boosting.first_gains(spark, rows, scorer.start(spark, d, n, n), cuts, scorer.settings).select("feature", "cut", "n_left", "gain"))


def ball_boosted_probs(spark, sf_dir):
    """The 49 balls' probabilities after the whole history, from trees that all balls share."""
    d, n = kept_history(spark, sf_dir)
    return boosting.BoostScorer(settings=boosting.Settings(trees=10)).probabilities(spark, d, n, n).select("color", F.col("ball").cast("long").alias("ball"), "prob")


def contrarian_pool(spark, sf_dir):
    return _rounded(scoring.red_pool(_ranked(spark, sf_dir)[3]).select("ball", "rn"))


def top_blue(spark, sf_dir):
    return _rounded(scoring.blue_pool(_ranked(spark, sf_dir)[3]).select("ball", "rn"))


def next_draw_labels(spark, sf_dir):
    d = history(spark, sf_dir)
    return _rounded(draws.next_labels(d).select("issue", "next_mask", "next_blue"))


def feature_mean_fill(spark, sf_dir):
    """Every draw's lags and means with the history's means for nulls; the last row by its own operator."""
    d, n = kept_history(spark, sf_dir)
    feats = files.materialised(spark, draws.features(d).select("idx", "issue", *draws.WINDOW_FEATURES), "features")
    columns = list(draws.WINDOW_FEATURES)
    return _rounded(draws.mean_filled(feats.where(F.col("idx") < n - 1), feats, columns).unionByName(draws.last_row_filled(feats, columns)))


def pool_combinations_kept(spark, sf_dir):
    """The combinations of the pool that the static rules keep, by enumeration that leaves out what they reject."""
    return combos.pruned_combinations(scoring.red_pool(_ranked(spark, sf_dir)[3])).select("mask")


def combo_rule_counts(spark, sf_dir):
    """How many of all combinations, and of the draws, each rule keeps."""
    kept = lambda df, name: df.agg(*(F.sum(F.when(f(), 1).otherwise(0)).alias(n) for n, f in rules.STATIC.items())).select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias(name)) for n in rules.STATIC))).alias("r")).select("r.*")
    return kept(combos.all_combinations(spark), "kept").join(kept(combos.with_keys(history(spark, sf_dir)), "draws_kept"), "rule")


def _dynamic_by_draw(d):
    """Each draw from the eleventh on, with what the rules see of the draws before it; a row a draw."""
    near = d.select("mask", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"), "idx").select((F.col("idx") + F.col("k")).alias("idx"), "k", F.col("mask").alias("m"))
    last = near.groupBy("idx").agg(*(F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in range(1, 11)))
    return d.join(last, "idx").where("idx >= 10")


def draw_rule_verdicts(spark, sf_dir):
    """All seventeen rules on every draw that has ten before it: how often it breaks each, and how often that one alone."""
    d, n = kept_history(spark, sf_dir)
    stats = scoring.ball_stats(spark, d, 1.0, 0, n - 1).where("color = 'red'")
    cold = stats.groupBy(F.col("step").alias("idx")).agg(F.sum(F.when(F.col("omission") > 15, fb.bit(F.col("ball"))).otherwise(F.lit(0).cast("long"))).alias("cold"))
    rows = combos.with_keys(_dynamic_by_draw(d)).join(cold, "idx")
    tests = {n: f() for n, f in rules.STATIC.items()} | {
        "r9_recent_overlap": rules.recent_overlap([F.col(f"m{k}") for k in range(1, 11)]), "r10_all_cold": rules.not_all_cold(F.col("cold")),
        "r16_related": rules.related(F.col("m1")), "r17_diagonal": rules.no_diagonal(F.col("m1"), F.col("m2")),
    }
    rows = rows.select("idx", F.explode(F.array(F.array(*(F.when(t, 0).otherwise(1) for t in tests.values())))).alias("bad"))
    rows = rows.select(F.aggregate("bad", F.lit(0), lambda a, x: a + x).alias("n_bad"), F.posexplode("bad").alias("at", "broken"))
    by = rows.groupBy("at").agg(F.count("*").alias("draws"), F.sum("broken").alias("broken"), F.sum(F.when(F.col("n_bad") == 1, F.col("broken")).otherwise(0)).alias("alone"))
    return by.select(F.get(F.array(*map(F.lit, tests)), F.col("at")).alias("rule"), "draws", "broken", "alone")


def combo_rules_joint(spark, sf_dir):
    """How many of all combinations, and of the draws, the fast rules keep, all applied ones, and those with the one that is off."""
    applied = [n for n in rules.STATIC if n not in rules.OFF]
    chains = {"fast": rules.FAST, "applied": applied, "with_primes": list(rules.STATIC)}
    counts = lambda df, prefix: df.agg(*(F.sum(F.when(rules.static_keep(names), 1).otherwise(0)).alias(prefix + k) for k, names in chains.items()))
    return counts(combos.all_combinations(spark), "").crossJoin(counts(combos.with_keys(history(spark, sf_dir)), "draws_"))


def _dynamic(spark, sf_dir, keep):
    d, _, stats = _last(spark, sf_dir)
    both = combos.all_combinations(spark).crossJoin(F.broadcast(combos.context(d, stats)))
    return both.groupBy(F.col("b1").cast("long").alias("b1")).agg(F.sum(F.when(keep, 1).otherwise(0)).alias("kept"))


def combo_recent_overlap(spark, sf_dir):
    return _dynamic(spark, sf_dir, rules.recent_overlap([F.col(f"m{k}") for k in range(1, 11)]))


def combo_all_cold(spark, sf_dir):
    return _dynamic(spark, sf_dir, rules.not_all_cold(F.col("cold")))


def combo_related(spark, sf_dir):
    return _dynamic(spark, sf_dir, rules.related(F.col("m1")))


def combo_diagonal(spark, sf_dir):
    return _dynamic(spark, sf_dir, rules.no_diagonal(F.col("m1"), F.col("m2")))


def _kept(spark, sf_dir):
    d, _, stats, rank = _ranked(spark, sf_dir)
    pool = scoring.red_pool(rank)
    return pool, combos.passed_of_pool(pool, combos.context(d, stats))


def rejection_anti(spark, sf_dir):
    """Combinations of the pool that are not in the library of rejected ones, by anti join; the library is the arithmetic one over all combinations."""
    pool = scoring.red_pool(_ranked(spark, sf_dir)[3])
    rejected = combos.all_combinations(spark).where(~rules.not_rejected(F.lit(42).cast("long"))).select("mask")
    return combos.not_in_library(combos.pool_combinations(pool), rejected).select("mask")


def coverage_semi(spark, sf_dir):
    """Combinations of the pool that are among all combinations that pass, by semi join."""
    d, _, stats, rank = _ranked(spark, sf_dir)
    passing = combos.passed(combos.all_combinations(spark), combos.context(d, stats))
    return combos.in_passed(combos.pool_combinations(scoring.red_pool(rank)), passing).select("mask")


def draw_overlaps(spark, sf_dir):
    """Every draw against all before it: how many share four balls or more, and the latest of them."""
    d, _ = kept_history(spark, sf_dir)
    return d.select("idx", "issue").join(overlap.earlier_overlaps(d), "idx").select("issue", F.col("n").alias("n_earlier"), F.col("last").alias("last_idx"))


def unseen_pairs_of_four(spark, sf_dir):
    """Combinations of the pool that share fewer than four balls with every one of the last 200 draws."""
    d, n, _, rank = _ranked(spark, sf_dir)
    return overlap.without_overlap(combos.pool_combinations(scoring.red_pool(rank)), d.where(F.col("idx") >= n - 200)).select("mask")


def draw_ranks(spark, sf_dir):
    """Each draw as an integer and back, its place in a permutation of all combinations, and whether the exact rejection sample holds it."""
    d = history(spark, sf_dir).select("issue", combinadic.rank().alias("rank"))
    d = combinadic.unranked(d.withColumn("place", combinadic.permuted(F.col("rank"), 42, inverse=True)), "rank")
    return d.select("issue", "rank", "place", combinadic.permuted(F.col("place"), 42).alias("rank_back"), "mask", (F.col("place") < combinadic.distinct_of(REJECTED_DRAWS)).alias("rejected"))


def sampled_combinations(spark, sf_dir):
    """As many combinations as there are orders, drawn without replacement; every one where there are more orders."""
    n = _table(spark, sf_dir, "orders").count()
    return combinadic.sampled(spark, min(n, combinadic.ALL), 42).select("place", "mask")


def candidate_list(spark, sf_dir):
    return combos.candidate_lines(_kept(spark, sf_dir)[1], all_of_them=True)


def coverage7_top(spark, sf_dir):
    pool, kept = _kept(spark, sf_dir)
    return combos.best7(combos.coverage7(kept, pool)).select(F.array_join("reds", ",").alias("reds"), "coverage")


def seeded_pick(spark, sf_dir):
    return combos.seeded_pick(_kept(spark, sf_dir)[1]).select("mask", "pick_key")


def _bets(spark):
    """Ten fixed single bets and two multi-number ones."""
    singles = spark.range(10).select(F.col("id").alias("bet_id"), F.array(*((F.col("id") * 3 + 5 * i) % 33 + 1 for i in range(6))).alias("reds"), (F.col("id") * 5 % 16 + 1).cast("int").alias("blue"))
    duplex = spark.createDataFrame([(1, [5, 6, 11, 14, 22, 26, 32], [1, 3, 6, 10, 12, 15, 16]), (2, [1, 5, 11, 12, 14, 22, 32, 33], [2, 4])], "bet_id long, reds array<int>, blues array<int>")
    return singles.withColumn("mask", fb.mask_from_array(F.col("reds"))).drop("reds"), duplex.withColumn("mask", fb.mask_from_array(F.col("reds"))).drop("reds")


def settle_single(spark, sf_dir):
    bets, wins = _bets(spark)[0], history(spark, sf_dir).select("mask", "blue")
    # counted by hits first: what is priced is a few rows
    s = settle.priced(settle.hit_counts(bets, wins))
    return s.groupBy("hit_text", "tier").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("prize")).alias("prize"))


def settle_duplex(spark, sf_dir):
    d = history(spark, sf_dir)
    bets = F.broadcast(_bets(spark)[1])  # two rows
    out = settle.settle_duplex(d.select("issue", F.col("mask").alias("wm"), F.col("blue").alias("wb")).crossJoin(bets).select("bet_id", "issue", "mask", "blues"), d.select("issue", "mask", "blue"), on="issue")
    return out.groupBy("bet_id", "red_hits", "blue_hits", "tier").agg(F.count("*").alias("draws"), F.sum("ways").alias("ways"), F.sum("prize").alias("prize")).select(F.col("bet_id").cast("long").alias("bet_id"), F.col("red_hits").cast("long").alias("red_hits"), F.col("blue_hits").cast("long").alias("blue_hits"), "tier", "draws", "ways", "prize")


def settle_duplex_all_blues(spark, sf_dir):
    """settle_duplex with each losing blue of a bet counted too."""
    d = history(spark, sf_dir)
    bets = F.broadcast(_bets(spark)[1])  # two rows
    out = settle.settle_duplex(d.select("issue").crossJoin(bets), d.select("issue", "mask", "blue"), on="issue", only_hit_blue=False)
    return _rounded(out.groupBy("bet_id", "tier").agg(F.sum("ways").alias("ways"), F.sum("prize").alias("prize")))


def tier_rollup(spark, sf_dir):
    s = settle.priced(settle.hit_counts(_bets(spark)[0], history(spark, sf_dir).select("mask", "blue")))
    return settle.tier_rollup(s.where("prize > 0").select("red_hits", "blue_hit", "n")).select("tier", F.col("tier_rank").cast("long").alias("tier_rank"), "n")


def _backtest(spark, sf_dir):
    d, n = kept_history(spark, sf_dir)
    return backtest.backtest(spark, d, TUNED, n)


def backtest_pnl(spark, sf_dir):
    return settle.profit(_backtest(spark, sf_dir))


def backtest_prize_counts(spark, sf_dir):
    return _rounded(settle.prize_counts(_backtest(spark, sf_dir)))


def backtest_by_step(spark, sf_dir):
    return _backtest(spark, sf_dir).groupBy("step").agg(F.count("*").alias("bets"), F.sum("prize").alias("prize"))


def ball_bayes_probs(spark, sf_dir):
    """Naive Bayes probabilities of every ball at each of the last 50 steps, from one pass over the history."""
    d, n = kept_history(spark, sf_dir)
    return _rounded(scoring.BayesScorer().probabilities(spark, d, n - BACKTEST_STEPS, n - 1))


def backtest_bayes(spark, sf_dir):
    """The backtest by step with a scorer that learns."""
    d, n = kept_history(spark, sf_dir)
    bets = backtest.backtest(spark, d, TUNED, n, scorer=scoring.BayesScorer())
    return bets.groupBy("step").agg(F.count("*").alias("bets"), F.sum("prize").alias("prize"))


def upsert_keep_last(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ingest.keep_last(e, ["user_id", "event_type"], ["event_id"])


def precedence_union(spark, sf_dir):
    """All orders as the rows that exist, over them the finished ones as HTML rows, over both the urgent ones as text rows."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("issue"), F.col("o_orderstatus").alias("val"), F.col("o_orderkey").alias("seq"), "o_orderpriority")
    existing = o.drop("o_orderpriority").withColumn("draw_date", F.lit("2020-01-01"))
    html = o.where("val = 'F'").drop("o_orderpriority").withColumn("val", F.lit("html"))
    text = o.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority").withColumn("val", F.lit("text")).withColumn("draw_date", F.lit("2021-01-01"))
    return ingest.upsert(existing, html, text).select("issue", "val", "draw_date")


def ingest_store(spark, sf_dir):
    """Two landed kinds of files merged into a store of draws, twice: all orders but the urgent ones are stored, the
    finished ones come as web pages of 500 rows, the urgent and the high ones as text lines. The second run finds nothing new."""
    kinds = ("o_orderstatus", "o_orderpriority")
    d = draws.draws_from_orders(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", *kinds), kinds)
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    d = files.materialised(spark, d.select(F.col("issue").cast("string").alias("issue"), F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), F.array(*map(two, fb.B)).alias("balls"), two("blue").alias("blue"), *kinds), "to-ingest")
    folder = files.made_path(spark, "ingest")
    stored = d.where("o_orderpriority <> '1-URGENT'").select("issue", F.lit("2000-01-01").alias("draw_date"), F.array_join("balls", ",").alias("reds"), F.lit("00").alias("blue"), F.lit(0).alias("at"))
    store.merge(spark, f"{folder}/store", stored, "issue", ["at"], range_rows=4000)
    row = F.concat(F.lit("<tr><td>"), "issue", F.lit("期</td><td>"), F.array_join("balls", " "), F.lit("</td><td>"), "blue", F.lit("</td></tr>"))
    pages = d.where("o_orderstatus = 'F'").groupBy(F.floor(F.col("issue").cast("long") / 500).alias("page")).agg(F.concat(F.lit("<html><table><tr><th>期号</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(f"{folder}/pages")
    line = F.concat_ws(" ", "issue", "draw_date", F.array_join("balls", " "), "blue", F.lit("0"), F.lit("0"))
    d.where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(line.alias("value")).write.text(f"{folder}/lines")
    first, again = (runs.ingest_files(spark, f"{folder}/store", f"{folder}/lines", f"{folder}/pages/*", range_rows=4000) for _ in range(2))
    return again.read(spark).withColumn("version", F.lit(again.number if again == first else -1).cast("long"))


def _landed_csv(spark, d) -> str:
    path = files.made_path(spark, "draws-csv")
    readers.write_draw_csv(d.select(F.col("issue").cast("string").alias("issue"), F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), F.concat_ws(",", *(F.lpad(F.col(b).cast("string"), 2, "0") for b in fb.B)).alias("reds"), F.lpad(F.col("blue").cast("string"), 2, "0").alias("blue")), path)
    return path


def csv_history(spark, sf_dir):
    """The history written as CSV files, read back and typed."""
    typed = readers.read_draws(spark, _landed_csv(spark, draws.draws_from_orders(_table(spark, sf_dir, "orders"))))
    return typed.select("issue", F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), F.array_join("reds", ",").alias("reds"), F.col("blue").cast("long").alias("blue"))


def csv_history_gbk(spark, sf_dir):
    """The history landed as CSV files in GBK, a file for each thousand issues, read back without being told so."""
    d = draws.draws_from_orders(_table(spark, sf_dir, "orders"))
    line = F.concat("issue", F.lit(","), F.date_format("draw_date", "yyyy-MM-dd"), F.lit(',"'), F.concat_ws(",", *(F.lpad(F.col(b).cast("string"), 2, "0") for b in fb.B)), F.lit('",'), F.lpad(F.col("blue").cast("string"), 2, "0"))
    # the header's bytes are no UTF-8; Spark's text writer writes a string's bytes as they are
    header = F.unhex(F.lit(",".join(CSV_HEADER).encode("gbk").hex()))
    rows = d.groupBy(F.floor(F.col("issue") / 1000).alias("part")).agg(F.array_join(F.collect_list(line), "\n").cast("binary").alias("lines"))
    path = files.made_path(spark, "draws-gbk")
    rows.select("part", F.concat(header, F.lit(b"\n"), "lines").cast("string").alias("value")).repartition("part").write.partitionBy("part").text(path)
    typed = readers.read_draws(spark, f"{path}/*")
    return typed.select("issue", F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), F.array_join("reds", ",").alias("reds"), F.col("blue").cast("long").alias("blue"))


def events_json(spark, sf_dir):
    """The numbers within the events' JSON, by type; malformed JSON has none."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"))


def pool_from_params_file(spark, sf_dir):
    """The pool under parameters that are read from a JSON file."""
    path = files.write_text(spark, json.dumps(asdict(TUNED)), f"{files.made_path(spark, 'params')}/best.json")
    params, there = Params.load(spark, path)
    d, n, stats = _last(spark, sf_dir)
    rank = scoring.ranked(scoring.scores(stats, scoring.SqlScorer().probabilities(spark, d, n, n), params))
    return _rounded(scoring.red_pool(rank).where(F.lit(there)).select("ball", "rn"))


def settle_from_files(spark, sf_dir):
    """The last draw, as CSV, against the report written from the draws before it: analysed, landed, found, parsed and settled."""
    d, n = kept_history(spark, sf_dir)
    last = d.where(F.col("idx") == n - 1).first()
    folder = files.made_path(spark, "reports")
    # the report names the next issue; the test history's issues have gaps
    runs.analyse_to_file(spark, runs.analyse(spark, d, n - 1, TUNED, periods=0), str(last.issue - 1), TUNED, True, folder, CLOCK)
    settled, _ = runs.settle_files(spark, _landed_csv(spark, d), f"{folder}/analysis_output_*.txt")
    return _rounded(settled.select("kind", "bet", F.array_join("reds", ",").alias("reds"), "red_hits", "blue_hits", "tier", "ways", "prize"))


def text_line_parse(spark, sf_dir):
    """History lines built from draws, with broken ones between, and every line of the documents besides."""
    d = history(spark, sf_dir)
    date = F.when(F.col("issue") % 7 == 0, F.lit("2024-01")).otherwise(F.date_format("draw_date", "yyyy-MM-dd"))
    name = F.concat(F.when(F.col("issue") % 11 == 0, "x").otherwise(""), F.col("issue").cast("string"))
    blue = F.when(F.col("issue") % 13 == 0, F.lit("")).otherwise(F.col("blue").cast("string"))
    lines = d.select(F.concat(F.lit(" "), F.concat_ws("  ", name, date, *(F.col(b).cast("string") for b in fb.B), blue)).alias("value"))
    prose = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return readers.parse_lines(lines.unionByName(prose)).select("issue", "draw_date", "reds", "blue")


def html_table_extract(spark, sf_dir):
    """Tables built on every page from its id, valid and broken rows, before the page's own markup."""
    p = _table(spark, sf_dir, "pages")
    k = F.col("page_id")
    num = lambda c: F.lpad((c).cast("string"), 2, "0")
    reds = F.concat_ws(" ", *(num((k * (i + 3)) % 30 + 1) for i in range(6)))
    row = lambda issue, r, b: F.concat(F.lit("<tr><td>"), issue, F.lit("期</td><td class='r'>"), r, F.lit("</td>\n<td>"), b, F.lit("</td></tr>"))
    s = k.cast("string")
    html = F.concat(F.lit("<TABLE id=t><tr><th>h</th></tr>"), row(s, reds, num(k % 18)), row(F.concat(s, F.lit("a")), reds, F.lit("01")), row(F.concat(F.lit("9"), s), F.concat(reds, F.lit(" 7")), F.lit("03")), F.lit("<tr><td>1</td><td>2</td></tr></TABLE>"), F.coalesce("html", F.lit("")))
    return readers.parse_html(p.select("page_id", html.alias("html"))).select("page_id", "issue", "reds", "blue")


def page_blocks(spark, sf_dir):
    """Every page's text blocks from its own markup: their number and length, the longest, and a digest of all."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(markup.text_blocks(F.col("html")))).alias("b"))
    long = lambda c: c.cast("long")
    return p.select("page_id", long(F.size("b")).alias("n_blocks"), long(F.length(F.array_join("b", ""))).alias("n_chars"), long(F.array_max(F.transform("b", F.length))).alias("longest"), F.sha2(F.array_join("b", "\n"), 256).alias("blocks_sha256"))


def _report_lines(spark, sf_dir):
    """A small report an order, of lines with good, malformed and foreign bets."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    header = F.when(F.col("k") % 2 == 0, "【7+N 复式推荐 (1组)】").otherwise("【7+7 复式推荐 (1组)】")
    nums = lambda n, step: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: ((F.col("k") + i * step) % 33 + 1).cast("string")), ", "), F.lit("]"))
    lines = F.array(
        F.concat(F.lit("Prediction_Target_Issue: "), (F.col("k") % 100).cast("string")), F.lit("--- 2. ---"), F.lit("红球 [1, 2] 蓝球 [03]"), F.lit("【单式推荐 (10组)】"),
        F.concat(F.lit("  组合  1: 红球 "), nums(6, 5), F.lit("   蓝球 [0"), (F.col("k") % 9 + 1).cast("string"), F.lit("]")), F.lit("  组合  2: 红球 [1, x]  蓝球 [01]"), F.lit("  组合  3: nothing"),
        F.lit(""), header, F.concat(F.lit("  红球: "), nums(7, 4)), F.concat(F.lit("  蓝球: "), nums(3, 2)), F.lit("====="), F.lit("红球 [4] 蓝球 [04]"),
    )
    path = F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 9, "0"))
    return o.select(path.alias("path"), F.posexplode(lines).alias("line_no", "line"))


def report_parse_bets(spark, sf_dir):
    return reports.parse_bets(_report_lines(spark, sf_dir)).select("path", "kind", F.array_join("reds", ",").alias("reds"), F.array_join("blues", ",").alias("blues"))


def report_match(spark, sf_dir):
    return reports.matching_report(_report_lines(spark, sf_dir), "42")


def next_issue(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("S"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("issue"))
    return o.select("o_orderkey", reports.next_issue("issue").alias("next_issue"))


def events_lag_ma5(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _rounded(e.select("event_id", draws.lag1("value")(w).alias("lag1"), draws.moving_mean("value")(w).alias("ma5")))


def event_type_decayed_freq(spark, sf_dir):
    e = draws.with_positions(_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    n = e.agg(F.max("idx").alias("n")).first().n
    return _rounded(e.groupBy("event_type").agg(F.sum(F.pow(F.lit(0.999), F.lit(n) - F.col("idx"))).alias("freq")))


def user_omission(spark, sf_dir):
    e = draws.with_positions(_table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    top = e.agg(F.max("idx").alias("top"))
    return e.groupBy("user_id").agg(F.max("idx").alias("last")).crossJoin(F.broadcast(top)).select("user_id", (F.col("top") - F.col("last")).alias("omission"))


def part_score_skip_topk(spark, sf_dir):
    """Parts of a brand without its 16 dearest: skip-k by partition."""
    p = _table(spark, sf_dir, "part")
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return p.select("p_brand", "p_partkey", rn.cast("long").alias("rn")).where("rn > 16")


def tiered_lookup_join(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 7).cast("int").alias("red_hits"), (F.col("l_quantity") % 2).cast("int").alias("blue_hit"))
    out = li.join(F.broadcast(prize_rules(spark)), ["red_hits", "blue_hit"], "left")
    return out.groupBy(F.coalesce("tier", F.lit("未中奖")).alias("tier")).agg(F.count("*").alias("n"), F.sum(F.coalesce("prize", F.lit(0))).cast("long").alias("prize"))


def _as_lines(spark, text: str):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string")


def analysis_report_lines(spark, sf_dir):
    """The whole run as a report: score, pools, picks, coverage, backtest."""
    d, n = kept_history(spark, sf_dir)
    basis = str(d.agg(F.max("issue")).first()[0])
    return _as_lines(spark, runs.analyse(spark, d, n, TUNED).text(basis, TUNED, True, CLOCK))


def _landed_reports(spark, sf_dir):
    """A report for each of the last 50 draws, each with its own backtest, written by tasks and read back."""
    d, n = kept_history(spark, sf_dir)
    found = runs.analyse_steps(spark, d, n - BACKTEST_STEPS, n - 1, TUNED)
    folder = files.made_path(spark, "reports")
    reports.write_texts(reports.analysis_texts(found, TUNED, True, BACKTEST_STEPS, CLOCK), folder)
    return d, reports.read_report_lines(spark, f"{folder}/*/*.txt")


def report_files_lines(spark, sf_dir):
    lines = _landed_reports(spark, sf_dir)[1]
    return lines.where("line <> '' OR line_no < 50").select(F.regexp_extract("path", "basis=([^/]*)/", 1).alias("basis"), F.col("line_no").cast("long").alias("line_no"), "line")


def report_files_settled(spark, sf_dir):
    d, lines = _landed_reports(spark, sf_dir)
    out = runs.settle_reports(lines, d)
    return out.groupBy("issue", "kind", "tier").agg(F.sum("ways").alias("ways"), F.sum("prize").alias("prize"))


def settlement_report_lines(spark, sf_dir):
    """The latest draw's settlement of the fixed bets, as a report."""
    win = history(spark, sf_dir).orderBy(F.desc("issue")).limit(1).select("issue", "reds", "mask", "blue")
    w = win.first()
    singles, duplex = _bets(spark)
    rows = settle.settle_single(singles, win).withColumn("reds", combos.mask_to_array(F.col("mask"))).orderBy("bet_id").collect()
    one = duplex.where("bet_id = 1").withColumn("reds", combos.mask_to_array(F.col("mask")))
    tiers = settle.settle_duplex(one, win).collect()
    first = one.first()
    both = {"reds": first.reds, "blues": first.blues, "red_hits": len(set(first.reds) & set(w.reds)), "blue_hits": int(w.blue in first.blues), "tiers": [(t.tier_rank, t.tier, t.ways) for t in tiers], "prize": sum(t.prize for t in tiers)}
    return _as_lines(spark, reports.settlement_report("report.txt", str(w.issue), list(w.reds), w.blue, [(r.reds, r.blue, r.hit_text, r.tier, r.prize) for r in rows], both, CLOCK))


_NAMES = """draws_wide draw_features_static draw_features_window ball_decayed_freq blue_decayed_freq ball_omission ball_stats_every_step ball_score_rank ball_split_gains ball_boosted_probs contrarian_pool top_blue
next_draw_labels csv_history csv_history_gbk events_json pool_from_params_file settle_from_files candidate_list pool_combinations_kept draw_overlaps unseen_pairs_of_four draw_ranks sampled_combinations feature_mean_fill combo_rule_counts draw_rule_verdicts combo_rules_joint combo_recent_overlap combo_all_cold combo_related combo_diagonal rejection_anti coverage_semi
coverage7_top seeded_pick settle_single settle_duplex settle_duplex_all_blues tier_rollup backtest_pnl backtest_prize_counts backtest_by_step ball_bayes_probs backtest_bayes upsert_keep_last ingest_store precedence_union text_line_parse
html_table_extract page_blocks report_parse_bets report_match next_issue events_lag_ma5 event_type_decayed_freq user_omission part_score_skip_topk tiered_lookup_join
analysis_report_lines report_files_lines report_files_settled settlement_report_lines""".split()


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES}
