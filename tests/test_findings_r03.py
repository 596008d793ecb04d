"""What the third round's findings asked for; each failed before its change."""

import random

import pytest
from pyspark.sql import functions as F

from ballast.functions import combinadic, scan
from ballast.operators import draws, scoring
from ballast.plans import queries


def history(spark, n):
    r = random.Random(n)
    rows = [(i, sorted(r.sample(range(1, 34), 6)), r.randrange(1, 17)) for i in range(n)]
    return draws.wide(spark.createDataFrame(rows, "idx long, reds array<int>, blue int"))


def test_more_orders_than_combinations(spark, tmp_path):
    spark.range(combinadic.ALL + 5).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    one = queries.sampled_combinations(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.count_distinct("mask").alias("masks"), F.max("place").alias("last")).first()
    assert (one.n, one.masks, one.last) == (combinadic.ALL, combinadic.ALL, combinadic.ALL - 1)


@pytest.mark.parametrize("decay,chunk,steps", [(0.9, 7, (100, 140)), (0.9, 4096, (299, 320)), (0.5, 64, (0, 320)), (1.0, 5, (50, 50)), (1.0, 4096, (310, 320)), (0.001, 10, (7, 30))])
def test_running_totals_of_known_steps_equal_plain_sums(spark, decay, chunk, steps):
    r = random.Random(chunk)
    events = [(r.choice("abc"), r.randrange(300), float(r.randrange(1, 4))) for _ in range(200)] + [("a", 5, 1.0)] * 3
    asked = [(k, s) for k in "abcd" for s in range(steps[0], steps[1] + 1)]
    out = scan.running_totals(spark.createDataFrame(events, "k string, idx long, weight double"), spark.createDataFrame(asked, "k string, step long"), ["k"], decay, chunk, steps=steps)
    got = {(x.k, x.step): (x.total, x.last) for x in out.collect()}
    assert len(got) == len(asked)
    for k, s in asked:
        seen = [(i, w) for e, i, w in events if e == k and i < s]
        assert got[k, s][1] == max((i for i, _ in seen), default=None)
        assert got[k, s][0] == pytest.approx(sum(w * decay ** (s - 1 - i) for i, w in seen), rel=1e-9, abs=1e-15)


def test_draws_meet_the_one_before_across_chunks(spark, monkeypatch):
    d = history(spark, 60)
    monkeypatch.setattr(draws.with_lags, "__defaults__", ("idx", 7))
    got = {x.idx: x for x in draws.with_previous(d, {"total": F.expr("b1 + b2 + b3 + b4 + b5 + b6")}).collect()}
    rows = {x.idx: x for x in d.collect()}
    assert sorted(got) == list(range(6, 60))
    for i, x in got.items():
        assert [x[f"b{k}"] for k in range(1, 7)] + [x.blue] == [rows[i][f"b{k}"] for k in range(1, 7)] + [rows[i].blue]
        assert x.total == sum(rows[i - 1][f"b{k}"] for k in range(1, 7))


@pytest.mark.parametrize("scorer,joins", [(scoring.SqlScorer, 0), (scoring.BayesScorer, 2)])
def test_scorers_join_no_events(spark, scorer, joins):
    """What stood before a draw comes with no join, and events are totals before they are shuffled: the joins that are left have a row a step and ball."""
    d = history(spark, 120)
    d.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/draws-{scorer.__name__}")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = scorer().probabilities(spark, spark.read.parquet(path), 100, 119)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum(plan.count(f"Join {kind}") for kind in ("Inner,", "LeftSemi,", "LeftOuter,")) == joins


def test_a_merge_that_changes_very_many_ranges(spark, tmp_path):
    from ballast.sources import store

    lows = {i: f"{i:05d}" if i else None for i in range(2500)}
    rows = spark.createDataFrame([(f"{i:05d}{x}", x, i) for i in (0, 1, 1234, 2499) for x in "ab"], "k string, v string, _range int")
    made = store._rewritten(spark, str(tmp_path), rows, "k", ["k", "v"], lows, 100)
    assert {i: [(r.low, r.rows) for r in found] for i, found in made.items() if found} == {i: [(lows[i], 2)] for i in (0, 1, 1234, 2499)}
    for i in (0, 1, 1234, 2499):
        assert sorted(r.k for r in spark.read.parquet(made[i][0].folder).collect()) == [f"{i:05d}a", f"{i:05d}b"]


def test_a_key_finds_its_range(spark):
    from bisect import bisect_right

    from ballast.sources import store

    r = random.Random(9)
    for n in (1, 2, 3, 64, 65, 1000):
        lows = [None, *sorted(f"{x:06d}" for x in r.sample(range(10**6), n - 1))]
        keys = [*lows[1:], "", "999999x", *(f"{r.randrange(10**6):06d}" for _ in range(50))]
        found = spark.createDataFrame([(k,) for k in keys], "k string").select("k", store._range_of(F.col("k"), lows).alias("at")).collect()
        assert all(x.at == bisect_right(lows[1:], x.k) for x in found)


def test_lines_that_say_nothing_are_not_sorted(spark):
    from ballast.sources import reports

    lines = spark.createDataFrame([("r", 0, "x")], "path string, line_no int, line string")
    plan = reports.parse_bets(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(line" in plan.split("Window [", 1)[1]


def test_scores_are_computed_once_a_cell(monkeypatch):
    """Rows that reach the same leaves have the same scores; sums over rows are what they were, and scores are made for fewer of them."""
    import numpy as np

    from ballast.operators import boosting as bo

    g, n = np.random.default_rng(4), 5000
    bins = g.integers(0, [7, 3, 5], (n, 3)).astype(np.uint8)
    y = bo.labels(g.integers(0, 1 << 34, n), g.integers(1, 17, n))
    forest = bo.Forest(np.append(g.normal(-1.5, 0.1, 47), [np.inf, -np.inf]))
    for _ in range(2):
        forest.splits.append(np.stack([g.integers(0, 3, 7), g.integers(0, 4, 7)], 1))
        forest.leaves.append(g.normal(0, 0.1, (8, 49)))
    made, scores = [], bo.Forest.scores
    monkeypatch.setattr(bo.Forest, "scores", lambda self, rows: made.append(len(rows)) or scores(self, rows))
    monkeypatch.setattr(bo, "_PART", 7)
    partial = np.array([[0, 2], [1, 0], [2, 3]])
    total = np.zeros((4, 3 * 8, 99))
    bo._add(total, forest, partial, bins, y)
    assert 7 < sum(made) <= 7 * 3 * 5 and max(made) <= 7
    p, want = bo.sigmoid(scores(forest, bins)), np.zeros_like(total)
    values = np.concatenate((p - y, p * (1 - p), np.ones((n, 1))), 1)
    for row, v in zip(bins, values):
        first = row[0] > 2
        node = 2 * first + (row[2] > 3 if first else row[1] > 0)
        for f in range(3):
            want[int(node), f * 8 + row[f]] += v
    assert np.allclose(total, want, rtol=1e-9, atol=1e-9) and (total[..., -1] == want[..., -1]).all()


def test_blocks_hold_every_row(monkeypatch):
    import pyarrow as pa

    from ballast.operators import boosting as bo

    monkeypatch.setattr(bo, "_BLOCK", 10)
    batches = [pa.record_batch({"x": list(range(i, i + 4))}) for i in range(0, 20, 4)]
    blocks = [t.column(0).to_pylist() for t in bo._blocks(batches)]
    assert [len(b) for b in blocks] == [12, 8] and sum(blocks, []) == list(range(20)) and list(bo._blocks([])) == []


def test_cut_points_are_values_at_exact_places(spark):
    from ballast.operators import boosting as bo

    n, rows = 400_003, spark.range(0, 400_003, numPartitions=4).select((F.col("id") * 7919 % 400_003).alias("a"), (F.col("id") % 3).alias("b"), F.lit(None).cast("long").alias("c"))
    got = bo.cut_points(rows, ["a", "b", "c"], 16)
    assert got == {"a": [float(-(-n * i // 16) - 1) for i in range(1, 16)], "b": [0.0, 1.0, 2.0], "c": []}
    assert bo.cut_points(rows.limit(0), ["a"], 16) == {"a": []}


def test_ids_of_many_words_are_cut_from_one_string(monkeypatch):
    """An array a word cost more than its look-up; the ids are those of the words one by one."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    _encode = pytest.importorskip("ballast.llm._encode")
    monkeypatch.setattr(_encode.np, "split", None)
    enc = _encode.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [w + x for w in ("data", "zqxv", "straße", "überlang", "a") for x in ("", "qz", "ing", "kwkw")] * 20
    assert enc._runs(words) == enc._whole(words) and enc._runs([]) == []
