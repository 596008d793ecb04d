"""What the fourth round's findings asked for: statistics of every step without a shuffled row a step and ball."""

import random

import pytest
from pyspark.sql import functions as F

from ballast.functions import scan
from ballast.operators import draws, scoring


def shuffled_rows(spark):
    """Rows that this session's stages have shuffled so far."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_statistics_of_every_step_shuffle_a_row_a_draw(spark):
    n, r = 12_000, random.Random(4)
    rows = [(i, sorted(r.sample(range(1, 34), 6)), r.randrange(1, 17)) for i in range(n)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/draws-of-every-step"
    draws.wide(spark.createDataFrame(rows, "idx long, reds array<int>, blue int")).write.mode("overwrite").parquet(path)
    before = shuffled_rows(spark)
    got = scoring.ball_stats(spark, spark.read.parquet(path), 0.999, 0, n).agg(F.count("*").alias("rows"), F.count_distinct("color", "ball").alias("balls"), F.sum("omission").alias("gaps")).first()
    last, gaps = {}, 0
    for step in range(n + 1):
        gaps += sum(step - 1 - last.get(key, -1) for key in [("red", b) for b in range(1, 34)] + [("blue", b) for b in range(1, 17)])
        if step < n:
            last |= {("red", b): step for b in rows[step][1]} | {("blue", rows[step][2]): step}
    assert (got.rows, got.balls, got.gaps) == (49 * (n + 1), 49, gaps)
    assert shuffled_rows(spark) - before < 3 * n


@pytest.mark.parametrize("decay,chunk,steps,n", [(0.9, 7, (0, 320), 300), (0.9, 7, (100, 140), 300), (0.5, 64, (299, 320), 300), (1.0, 5, (50, 50), 300), (1.0, 4096, (0, 300), 300), (0.001, 10, (7, 30), 300), (0.9, 4, (0, 20), 0)])
def test_slot_totals_equal_plain_sums(spark, decay, chunk, steps, n):
    r = random.Random(chunk)
    events = [(r.randrange(n), r.randrange(1, 8)) for _ in range(n // 2)] + [(5, 1)] * (3 if n else 0)
    out = scan.slot_totals(spark.createDataFrame(events, "idx long, bits long"), [F.struct(F.lit(k).alias("k")) for k in "abcd"], steps, decay, chunk).collect()
    got = {(x.k, x.step): (x.total, x.last) for x in out}
    assert len(got) == len(out) == 4 * (steps[1] - steps[0] + 1)
    for i, k in enumerate("abcd"):
        for s in range(steps[0], steps[1] + 1):
            seen = [at for at, bits in events if bits >> i & 1 and at < s]
            assert got[k, s][1] == max(seen, default=None)
            assert got[k, s][0] == pytest.approx(sum(decay ** (s - 1 - at) for at in seen), rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("few", [0, 1000])
def test_repeated_balls_count_again_and_other_numbers_are_no_balls(spark, monkeypatch, few):
    monkeypatch.setattr(scoring, "FEW_STEPS", few)
    rows = [(0, [1, 1, 1, 5, 33, 33], 16), (1, [0, 1, 2, 3, 34, 40], 0), (2, [-3, 2, 2, 3, 4, 33], None), (3, [1, 1, 1, 1, 1, 1], 17)]
    d = draws.wide(spark.createDataFrame(rows, "idx long, reds array<int>, blue int"))
    got = {(x.step, x.color, x.ball): (x.freq, x.omission) for x in scoring.ball_stats(spark, d, 0.5, 0, 4).collect()}
    assert len(got) == 5 * 49
    for (step, color, ball), (freq, omission) in got.items():
        at = [i for i, reds, blue in rows if i < step for b in (reds if color == "red" else [blue]) if b == ball]
        assert freq == pytest.approx(sum(0.5 ** (step - 1 - i) for i in at)) and omission == step - 1 - max(at, default=-1)
