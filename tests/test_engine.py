from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ballast.functions import balls as fb
from ballast.functions import rules
from ballast.operators import backtest, combos, draws, ingest, scoring, settle
from ballast.schema import TUNED, Params
from ballast.sources import readers, reports


def combo_frame(spark, tuples):
    return combos.with_keys(spark.createDataFrame([(*t, str(t)) for t in tuples], ", ".join(f"b{i} int" for i in range(1, 7)) + ", name string"))


# --- rules -------------------------------------------------------------------

#: (rule, kept, rejected), at each boundary
EDGES = [
    ("r1_not_regular", (1, 2, 3, 4, 5, 7), (1, 2, 3, 4, 5, 6)), ("r1_not_regular", (1, 6, 11, 16, 21, 27), (1, 6, 11, 16, 21, 26)),
    ("r2_sum", (1, 2, 3, 4, 27, 33), (1, 2, 3, 4, 26, 33)), ("r2_sum", (1, 30, 31, 32, 33, 33), (2, 30, 31, 32, 33, 33)),
    ("r3_span", (1, 3, 5, 7, 9, 16), (1, 3, 5, 7, 9, 15)),
    ("r4_runs", (1, 2, 3, 10, 11, 20), (1, 2, 3, 4, 10, 20)), ("r4_runs", (1, 2, 5, 6, 9, 11), (1, 2, 5, 6, 9, 10)),
    ("r5_zones", (1, 2, 3, 4, 5, 12), (1, 2, 3, 4, 5, 11)), ("r5_zones", (12, 13, 14, 15, 16, 23), (12, 13, 14, 15, 16, 22)), ("r5_zones", (22, 23, 24, 25, 26, 27), (23, 24, 25, 26, 27, 28)),
    ("r7_primes", (1, 2, 4, 6, 8, 9), (1, 4, 6, 8, 9, 10)), ("r7_primes", (1, 2, 3, 5, 8, 9), (1, 2, 3, 5, 7, 9)),
    ("r8_big_small", (1, 2, 17, 18, 19, 20), (1, 17, 18, 19, 20, 21)), ("r8_big_small", (1, 2, 3, 16, 17, 18), (1, 2, 3, 4, 16, 17)),
    ("r11_odd_even", (1, 3, 5, 7, 8, 10), (1, 3, 5, 7, 9, 10)), ("r11_odd_even", (1, 3, 4, 6, 8, 10), (1, 4, 6, 8, 10, 12)),
    ("r12_mod3", (1, 2, 3, 4, 7, 10), (1, 2, 4, 5, 7, 8)),
    ("r13_tails", (1, 11, 2, 3, 4, 5), (1, 11, 21, 2, 3, 4)),
    ("r14_head_tail", (10, 11, 12, 13, 14, 25), (11, 12, 13, 14, 15, 25)), ("r14_head_tail", (10, 11, 12, 13, 14, 25), (10, 11, 12, 13, 14, 24)),
    ("r15_tail_sum", (1, 2, 3, 4, 5, 10), (1, 2, 3, 4, 10, 14)), ("r15_tail_sum", (5, 6, 8, 9, 9, 18), (6, 7, 8, 9, 9, 19)),
]


def test_rule_boundaries(spark):
    df = combo_frame(spark, sorted({t for _, *ts in EDGES for t in ts}))
    got = {r.name: r for r in df.select("name", *(f().alias(n) for n, f in rules.STATIC.items())).collect()}
    for name, keep, reject in EDGES:
        assert got[str(keep)][name] is True and got[str(reject)][name] is False, (name, keep, reject)


def test_pass_counts(spark):
    c = combos.all_combinations(spark)
    want = {"r1_not_regular": 1107475, "r2_sum": 1032301, "r3_span": 1066527, "r4_runs": 1092924, "r5_zones": 1106182, "r6_ac": 992874, "r7_primes": 791560, "r8_big_small": 913920, "r11_odd_even": 913920, "r12_mod3": 885115, "r13_tails": 1034235, "r14_head_tail": 875028, "r15_tail_sum": 1063754}
    applied = [n for n in rules.STATIC if n not in rules.OFF]
    got = c.agg(F.count("*").alias("all"), *(F.count(F.when(f(), 1)).alias(n) for n, f in rules.STATIC.items()), F.count(F.when(rules.static_keep(), 1)).alias("fast"), F.count(F.when(rules.static_keep(applied), 1)).alias("applied"), F.count(F.when(rules.static_keep(applied + ["r7_primes"]), 1)).alias("primes")).first().asDict()
    assert got == {**want, "all": 1107568, "fast": 413198, "applied": 413198, "primes": 308704}


def test_dynamic_rules(spark):
    df = combo_frame(spark, [(1, 2, 3, 4, 20, 30), (6, 9, 12, 15, 18, 33)])
    m = lambda *xs: F.lit(sum(1 << x for x in xs)).cast("long")
    row = lambda c: [r[0] for r in df.orderBy("b1").select(c).collect()]
    assert row(rules.recent_overlap([m(1, 2, 3, 31, 32, 33)])) == [True, True]
    assert row(rules.recent_overlap([m(5, 7, 8, 31, 32, 33), m(1, 2, 3, 4, 32, 33)])) == [False, True]
    assert row(rules.not_all_cold(m(6, 9, 12, 15, 18, 33))) == [True, False]
    assert row(rules.related(m(5, 26, 27, 28, 29, 31))) == [True, True]
    assert row(rules.related(m(22, 24, 25, 26, 27, 28))) == [False, False]
    assert row(rules.no_diagonal(m(8), m(7))) == [True, False]


# --- statistics --------------------------------------------------------------


def history(spark, n=130, seed=3):
    import random

    r = random.Random(seed)
    rows = [(10 * i, sorted(r.sample(range(1, 33), 6)), r.randrange(1, 16)) for i in range(n)]
    df = draws.with_positions(draws.wide(spark.createDataFrame(rows, "issue long, reds array<int>, blue int")), "issue")
    return rows, df.persist()


def test_positions_and_lags_cross_chunks(spark):
    rows, d = history(spark)
    assert sorted((r.issue, r.idx) for r in d.collect()) == [(10 * i, i) for i in range(130)]
    f = draws.with_lags(draws.static_features(d), draws.WINDOW_FEATURES, 5, chunk=7)
    got = {r.idx: r for r in f.collect()}
    assert len(got) == 130
    sums = [sum(x) for _, x, _ in rows]
    for i in range(130):
        assert got[i].red_sum_lag1 == (sums[i - 1] if i else None)
        assert got[i].red_sum_ma5 == (pytest.approx(sum(sums[i - 5 : i]) / 5) if i >= 5 else None)
    last = draws.last_row_filled(f, ["red_sum_ma5", "blue_lag1"]).first()
    assert last.issue == 1290 and last.red_sum_ma5 == got[129].red_sum_ma5


@pytest.mark.parametrize("keys", [[3, 1, 2], [5] * 50 + [None] * 3 + [7], [*range(400), 1 << 45], [-(1 << 60), *range(50), 1 << 60], []])
def test_positions_of_uneven_keys(spark, keys):
    df = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(keys)], "k long, v string").repartition(3)
    rows = draws.with_positions(df, "k", ties=("v",)).collect()
    assert [(r.k, r.v) for r in sorted(rows, key=lambda r: r.idx)] == sorted(((k, f"v{i}") for i, k in enumerate(keys)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted(r.idx for r in rows) == list(range(len(keys)))


def test_one_stray_key_or_one_value_makes_no_large_partition(spark):
    from ballast.sources import files

    at = len(files._MADE)
    many = spark.range(300_000).unionByName(spark.createDataFrame([(1 << 45,)], "id long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (many.withColumn("k", F.col("id")), many.withColumn("k", F.lit(1))):
            with files.cleared(spark):
                draws.with_positions(df, "k").count()
                sizes = [r.n for r in spark.read.parquet(files._MADE[-1]).groupBy(draws.partition_and_place("_place")[0]).agg(F.count("*").alias("n")).collect()]
            assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files._MADE) == at


def test_statistics_by_step_equal_plain_loops(spark):
    rows, d = history(spark)
    got = {(r.step, r.color, r.ball): r for r in scoring.ball_stats(spark, d, 0.99, 120, 130).collect()}
    for s in (120, 125, 130):
        for ball in (1, 7, 32, 33):
            at = [i for i in range(s) if ball in rows[i][1]]
            r = got[s, "red", ball]
            assert r.freq == pytest.approx(sum(0.99 ** (s - 1 - i) for i in at)) and r.omission == (s - 1 - at[-1] if at else s)
    assert got[130, "red", 33].freq == 0 and got[130, "blue", 16].omission == 130


@pytest.mark.parametrize("decay,chunk", [(0.9, 7), (0.9, 4096), (0.5, 64), (1.0, 5), (0.001, 10), (0.999999, 3)])
def test_running_totals_equal_plain_sums(spark, decay, chunk):
    import random

    from ballast.functions import scan

    r = random.Random(chunk)
    events = [(r.choice("abc"), r.randrange(300), float(r.randrange(1, 4))) for _ in range(200)] + [("a", 5, 1.0)] * 3
    queries = [(k, s) for k in "abcd" for s in (*range(0, 320, 3), 5, 5)]
    out = scan.running_totals(spark.createDataFrame(events, "k string, idx long, weight double"), spark.createDataFrame([(k, s, "x") for k, s in queries], "k string, step long, note string"), ["k"], decay, chunk)
    got = sorted((x.k, x.step, x.total, -1 if x.last is None else x.last, x.note) for x in out.collect())
    want = sorted((k, s, sum(w * decay ** (s - 1 - i) for e, i, w in events if e == k and i < s), max((i for e, i, _ in events if e == k and i < s), default=-1), "x") for k, s in queries)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[3:] == b[3:] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-15)


def test_running_totals_of_nothing(spark):
    from ballast.functions import scan

    none, one = spark.createDataFrame([], "k string, idx long, weight double"), spark.createDataFrame([("a", 3)], "k string, step long")
    assert [tuple(r) for r in scan.running_totals(none, one, ["k"], 0.9).collect()] == [("a", 3, 0.0, None)]
    assert scan.running_totals(none, one.limit(0), ["k"], 0.9).count() == 0


def test_scores_do_not_see_the_future(spark):
    rows, d = history(spark)
    changed = d.where("idx < 125").unionByName(d.where("idx >= 125").withColumn("blue", F.lit(1)).withColumn("mask", F.lit(126).cast("long")).withColumns({f"b{i}": F.lit(i) for i in range(1, 7)}))

    def at(frame):
        stats = scoring.ball_stats(spark, frame, 0.99, 121, 129)
        probs = scoring.SqlScorer().probabilities(spark, frame, 121, 129)
        return {(r.step, r.color, r.ball): r.score for r in scoring.scores(stats, probs, TUNED).where("step <= 125").collect()}

    a = at(d)
    assert a == at(changed) and len(a) == 5 * 49


def test_pool_ties_and_sizes(spark):
    rank = scoring.ranked(spark.createDataFrame([(1, "red", b, 0.5) for b in range(1, 34)] + [(1, "blue", b, 0.5) for b in range(1, 17)], "step int, color string, ball int, score double"))
    assert sorted(r.ball for r in scoring.red_pool(rank).collect()) == list(range(17, 34))
    assert sorted(r.ball for r in scoring.blue_pool(rank).collect()) == list(range(1, 8))
    assert combos.pool_combinations(scoring.red_pool(rank)).count() == 12376


def test_coverage_equals_direct_count(spark):
    import random

    pool = list(range(1, 12))
    kept = random.Random(1).sample(list(combinations(pool, 6)), 120)
    frame = combo_frame(spark, kept).withColumn("step", F.lit(1))
    cov = combos.coverage7(frame, spark.createDataFrame([(1, b) for b in pool], "step int, ball int"))
    got = {tuple(r.reds): r.coverage for r in cov.select(combos.mask_to_array(F.col("mask7")).alias("reds"), "coverage").collect()}
    want = {s: n for s in combinations(pool, 7) if (n := sum(set(k) <= set(s) for k in kept))}
    assert got == want
    best = combos.best7(cov).first()
    assert tuple(best.reds) == min(s for s in want if want[s] == max(want.values()))


def test_rejection_library(spark):
    lib = combos.rejection_library(spark, 7, 3000)
    assert lib.count() > 2950 and lib.where(F.bit_count("mask") != 6).count() == 0
    assert lib.exceptAll(combos.rejection_library(spark, 7, 3000)).count() == 0
    assert combos.not_in_library(lib, lib).count() == 0


# --- settlement --------------------------------------------------------------

ISSUE_A, ISSUE_B = ([3, 4, 7, 13, 20, 30], 3), ([1, 5, 8, 14, 19, 23], 6)


def win(spark, reds, blue):
    return draws.wide(spark.createDataFrame([(reds, blue)], "reds array<int>, blue int"))


def single(spark, reds, blue):
    return spark.createDataFrame([(1, reds, blue)], "bet_id int, reds array<int>, blue int").withColumn("mask", fb.mask_from_array(F.col("reds")))


def duplex(spark, reds, blues):
    return spark.createDataFrame([(1, reds, blues)], "bet_id int, reds array<int>, blues array<int>").withColumn("mask", fb.mask_from_array(F.col("reds")))


def test_single_goldens(spark):
    a = settle.settle_single(single(spark, [5, 6, 7, 14, 22, 26], 1), win(spark, *ISSUE_A)).first()
    assert (a.hit_text, a.tier, a.prize) == ("命中1+0", "未中奖", 0)
    b = settle.settle_single(single(spark, [1, 5, 8, 11, 14, 22], 1), win(spark, *ISSUE_B)).first()
    assert (b.hit_text, b.tier, b.prize) == ("命中4+0", "五等奖", 10)


@pytest.mark.parametrize("reds, blues, issue, want", [
    ([5, 6, 11, 14, 22, 26, 32], [1, 3, 6, 10, 12, 15, 16], ISSUE_A, {"六等奖": (7, 35)}),
    ([1, 5, 11, 12, 14, 22, 32], [1, 4, 8, 9, 14, 15, 16], ISSUE_B, {}),
    ([3, 4, 7, 13, 20, 30, 31], [3], ISSUE_A, {"一等奖": (1, 5_000_000), "三等奖": (6, 18_000), "四等奖": (0, 0), "五等奖": (0, 0), "六等奖": (0, 0)}),
    ([3, 4, 7, 13, 31, 32, 33], [3, 4], ISSUE_A, {"四等奖": (3, 600), "五等奖": (4, 40), "六等奖": (0, 0)}),
    ([3, 4, 7, 13, 20, 32, 33], [1], ISSUE_A, {"四等奖": (2, 400), "五等奖": (5, 50)}),
])
def test_duplex_goldens(spark, reds, blues, issue, want):
    rows = settle.settle_duplex(duplex(spark, reds, blues), win(spark, *issue)).collect()
    assert {r.tier: (r.ways, r.prize) for r in rows} == want


def test_settlement_report_text():
    text = reports.settlement_report("report.txt", "2025129", ISSUE_A[0], 3, [([5, 6, 7, 14, 22, 26], 1, "命中1+0", "未中奖", 0)], {"reds": [5, 6, 11, 14, 22, 26, 32], "blues": [1, 3], "red_hits": 0, "blue_hits": 1, "tiers": [(6, "六等奖", 7)], "prize": 35}, datetime(2025, 11, 10, 6, 17, 50))
    assert "  组合  1: [5, 6, 7, 14, 22, 26]    蓝球 [01] -> 命中1+0, 未中奖, 奖金: 0 元" in text.split("\n")
    assert text.split("\n")[-2] == "总计中奖金额: 35 元" and "    - 六等奖: 7 注" in text


# --- ingest and sources ------------------------------------------------------


def test_text_lines(spark):
    lines = ["2025130 2025-11-11 01 05 08 14 19 23 06 9 9", "x1 2025-11-11 1 2 3 4 5 6 7", "1 2025-11 1 2 3 4 5 6 7", "1 2025-11-11 1 2 3 4 5 6", "", "  7\t2025-1-1  1 2 3 4 5 6 99 "]
    got = readers.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("2025130", "2025-11-11", "01,05,08,14,19,23", "06"), ("7", "2025-1-1", "1,2,3,4,5,6", "99")]


def test_html_rows(spark):
    row = lambda *c: "<tr>" + "".join(f"<td class=x> {x} </td>" for x in c) + "</tr>"
    good = row("2025130期", "01 05 08 14 19 23", "06")
    bad = [row("1", "2"), row("2", "1 2 3 4 5", "6"), row("3", "1 2 3 4 5 6", "0"), row("4", "1 2 3 4 5 6", "17"), row("5", "1  2 3 4 5 6", "7"), row("a", "1 2 3 4 5 6", "7")]
    html = f"<p><table><tr><th>期</th></tr>{''.join(bad)}{good}</table><table>{row('h', 'h', 'h')}{row('9', '1 2 3 4 5 6', '7')}</table>"
    got = readers.parse_html(spark.createDataFrame([(html,), ("no table",), (None,)], "html string")).collect()
    assert [tuple(r) for r in got] == [("2025130", "01,05,08,14,19,23", "06")]


def test_upsert_precedence(spark):
    csv = spark.createDataFrame([("1", "2020-01-01", "csv", 0), ("2", "2020-01-02", "csv", 1), ("3", "2020-01-03", "csv", 2)], "issue string, draw_date string, reds string, seq int")
    html = spark.createDataFrame([("2", "html", 0), ("3", "html", 1), ("4", "a", 2), ("4", "b", 3)], "issue string, reds string, seq int")
    text = spark.createDataFrame([("3", "2021-01-01", "text", 0)], csv.schema)
    got = {r.issue: (r.draw_date, r.reds) for r in ingest.upsert(csv, html, text).collect()}
    assert got == {"1": ("2020-01-01", "csv"), "2": (None, "html"), "3": ("2021-01-01", "text"), "4": (None, "b")}


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_csv_round_trip(spark, tmp_path, encoding):
    path = tmp_path / "draws.csv"
    flags = spark.conf.get("spark.sql.legacy.javaCharsets")
    path.write_bytes('期号,日期,红球,蓝球\n2025129,2025-11-09,"30,04,07,13,20,03",03\n2025130,,"1,2,3,4,5,6",7\n'.encode(encoding))
    raw = readers.read_draw_csv_any(spark, str(path))
    typed = readers.typed_draws(raw).orderBy("issue").collect()
    assert (typed[0].issue, typed[0].reds, typed[0].blue, str(typed[0].draw_date), typed[1].draw_date) == (2025129, [3, 4, 7, 13, 20, 30], 3, "2025-11-09", None)
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == flags
    readers.write_draw_csv(raw, str(tmp_path / "out"))
    again = readers.read_draw_csv(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, raw.collect()))


def test_report_search(spark, tmp_path):
    for name, target in (("analysis_1.txt", "7"), ("analysis_2.txt", "7"), ("analysis_3.txt", "8")):
        (tmp_path / name).write_text(f"x\nPrediction_Target_Issue: {target}\nPrediction_Target_Issue: 9\n")
    lines = reports.read_report_lines(spark, str(tmp_path / "analysis_*.txt"))
    assert reports.matching_report(lines, "7").first().path.endswith("analysis_2.txt")
    assert reports.matching_report(lines, "9").count() == 0


def test_next_issue_and_params(spark, tmp_path):
    assert reports.next_issue_of("2026090") == "2026091" and reports.next_issue_of("x") == "x_Next"
    assert Params.load(spark, str(tmp_path / "none.json")) == (Params(), False)
    (tmp_path / "p.json").write_text('{"decay_factor": 0.9, "hot_bonus": 1.5}')
    p, loaded = Params.load(spark, str(tmp_path / "p.json"))
    assert loaded and p.decay_factor == 0.9 and p.weight_freq == 0.3 and p.shown()["hot_bonus"] == 1.5
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        Params.load(spark, str(tmp_path / "bad.json"))


def test_backtest_needs_history(spark):
    _, d = history(spark, 99)
    assert backtest.backtest(spark, d, TUNED, 99) is None
    bets = backtest.backtest(spark, d, TUNED, 99, periods=3)
    total = settle.profit(bets).first()
    assert total.cost == 2 * total.bets and total.profit == total.winnings - total.cost
    assert sorted(r.step for r in bets.select("step").distinct().collect()) == [96, 97, 98]


# --- runs from files -----------------------------------------------------------


def test_analyse_then_settle_through_files(spark, tmp_path):
    from ballast.plans import runs

    _, d = history(spark, 160)
    d = d.persist()
    last = d.where("idx = 159").first()
    now, folder = datetime(2026, 1, 2, 3, 4, 5), str(tmp_path / "report")
    found = runs.analyse(spark, d, 159, TUNED, periods=3)
    path = runs.analyse_to_file(spark, found, str(last.issue - 1), TUNED, True, folder, now)
    assert path.endswith("analysis_output_20260102_030405.txt")
    raw = d.select(F.col("issue").cast("string"), F.lit("2026-01-01").alias("draw_date"), F.array_join("reds", ",").alias("reds"), F.col("blue").cast("string").alias("blue"))
    readers.write_draw_csv(raw, str(tmp_path / "csv"))
    settled, about = runs.settle_files(spark, str(tmp_path / "csv"), f"{folder}/analysis_output_*.txt")
    rows = settled.collect()
    assert about["issue"] == str(last.issue) and about["blue"] == last.blue
    assert [list(r.reds) for r in sorted((r for r in rows if r.kind == "single"), key=lambda r: r.bet)] == found.picks
    assert all(r.red_hits == len(set(r.reds) & set(last.reds)) and r.blue_hits == int(last.blue in r.blues) for r in rows)
    out = runs.settle_to_file(spark, str(tmp_path / "csv"), f"{folder}/*.txt", folder, now)
    text = open(out, encoding="utf-8").read()
    assert out.endswith("bonus_check_20260102_030405.txt") and f"总计中奖金额: {sum(r.prize for r in rows)} 元" in text
    with pytest.raises(ValueError):
        runs.settle_files(spark, str(tmp_path / "csv"), f"{folder}/nothing_*.txt")
    d.unpersist()


def test_landed_files(spark, tmp_path):
    from ballast.sources import files

    assert readers.read_text_history(spark, str(tmp_path / "missing.txt")).count() == 0
    path = files.write_text(spark, "2025001 2025-01-01 1 2 3 4 5 6 7 rest\n\nprose 1 2\n", str(tmp_path / "a" / "landed.txt"))
    files.write_text(spark, open(path).read() + "\t2025002 2025-01-03 2 3 4 5 6 7 8", path)
    assert [r.issue for r in readers.read_text_history(spark, path).orderBy("issue").collect()] == ["2025001", "2025002"]
    assert [x.name for x in (tmp_path / "a").iterdir() if not x.name.startswith(".")] == ["landed.txt"]


def test_candidates_are_listed_when_few(spark):
    few = combo_frame(spark, [(1, 2, 3, 4, 5, 7), (1, 2, 3, 4, 5, 6)])
    assert [r.line for r in combos.candidate_lines(few).orderBy("line_no").collect()] == ["  组合  1: 01 02 03 04 05 06", "  组合  2: 01 02 03 04 05 07"]
    assert combos.candidate_lines(few, threshold=2).count() == 0
    assert combos.candidate_lines(few, threshold=2, all_of_them=True).orderBy("line_no").first().line == "  组合   1: 01 02 03 04 05 06"


def test_many_bets_are_not_broadcast(spark, monkeypatch):
    bets = combo_frame(spark, [(1, 2, 3, 4, 5, 6), (2, 3, 4, 5, 6, 7)]).withColumn("blue", F.lit(1))
    wins = combo_frame(spark, [(1, 2, 3, 4, 5, 7), (8, 9, 10, 11, 12, 13)]).select("mask", F.lit(1).alias("blue"))
    key = lambda df: sorted(map(str, df.select("name", "red_hits", "blue_hit", "prize").collect()))
    whole = key(settle.settle_single(bets, wins))
    monkeypatch.setattr(settle, "FEW", 1)
    assert len(whole) == 4 and key(settle.settle_single(bets, wins)) == whole


def test_losing_blues_counted_on_demand(spark):
    bets = combo_frame(spark, [(1, 2, 3, 4, 5, 6)]).withColumn("blues", F.array(F.lit(1), F.lit(2), F.lit(3)))
    wins = combo_frame(spark, [(1, 2, 3, 4, 5, 6)]).select("mask", F.lit(2).alias("blue"))
    got = {(r.tier, r.ways): r.prize for r in settle.settle_duplex(bets, wins, only_hit_blue=False).collect() if r.ways}
    assert got == {("一等奖", 1): 5_000_000, ("二等奖", 2): 200_000}
