import random

import pytest
from pyspark.sql import functions as F

from ballast.functions import rules
from ballast.operators import combos, scoring


def generated(df) -> int:
    """Rows that the generators of a plan made when it ran."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if kind == "GenerateExec":
            total += node.metrics().get("numOutputRows").get().value()
    return total


def test_same_rows_as_the_filter_from_at_most_half(spark):
    """Pools as scores make them: 17 balls, here of random scores, ties among them."""
    r = random.Random(5)
    scored = spark.createDataFrame([(s, "red", b, float(r.randrange(20))) for s in range(25) for b in range(1, 34)], "step long, color string, ball int, score double")
    pool = scoring.red_pool(scoring.ranked(scored)).persist()
    pool.count()
    plain, cut = combos.pool_combinations(pool), combos.pruned_combinations(pool)
    key = lambda df: sorted(map(tuple, df.select("step", *combos.fb.B, "mask", "tails").collect()))
    assert key(cut) == key(plain.where(rules.static_keep()))
    a, b = generated(plain.agg(F.count("*"))), generated(cut.agg(F.count("*")))
    assert 0 < b <= a / 2, (a, b)
    pool.unpersist()


@pytest.mark.parametrize("balls", [range(1, 34), range(1, 7), range(28, 34), [1, 2, 3, 4, 5], [3, 9, 10, 14, 25, 32], range(1, 34, 2)])
def test_odd_pools(spark, balls):
    pool = spark.createDataFrame([(1, b) for b in balls], "step long, ball int")
    want = combos.pool_combinations(pool).where(rules.static_keep())
    got = combos.pruned_combinations(pool)
    hashed = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("mask", "tails", "b1", "b6").cast("decimal(38,0)"))).first())
    assert hashed(got) == hashed(want)
    if len(balls) == 33:
        assert hashed(got)[0] == 413198
