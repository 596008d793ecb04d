import math
import random

import pytest
from pyspark.sql import functions as F

from ballast.operators import backtest, boosting, draws, scoring
from ballast.schema import TUNED
from ballast.sources import files


@pytest.fixture(scope="module")
def history(spark):
    """110 draws of balls 1..32 and blues 1..15, so one red and one blue never come; ball 1 always does."""
    r = random.Random(11)
    rows = [(i, sorted([1, *r.sample(range(2, 33), 5)]), r.randrange(1, 16)) for i in range(110)]
    d = draws.with_positions(draws.wide(spark.createDataFrame(rows, "issue long, reds array<int>, blue int")), "issue")
    return rows, d.select("issue", "idx", *(f"b{i}" for i in range(1, 7)), "blue", "mask").persist()


FEATURES = ["red_sum", "odd_count_lag1", "blue_ma5"]


def plain(rows, step, first_step, st):
    """Probabilities of one step by loops over rows, splits and balls."""
    feats = []
    for i, (_, reds, _) in enumerate(rows):
        odd = lambda k: sum(x % 2 for x in rows[k][1])
        feats.append((float(sum(reds)), float(odd(i - 1)) if i else None, sum(rows[k][2] for k in range(i - 5, i)) / 5 if i >= 5 else None))
    cuts = []
    for f in range(3):
        own = sorted(feats[i][f] for i in range(5, first_step - 1))
        cuts.append(sorted({own[math.ceil(k / st.bins * len(own)) - 1] for k in range(1, st.bins)}))
    bins = {i: [sum(c < feats[i][f] for c in cuts[f]) for f in range(3)] for i in range(5, step)}
    known = list(range(5, step - 1))
    came = {(c, b): [(b in rows[i + 1][1]) if c == "red" else rows[i + 1][2] == b for i in known] for c, b in boosting.BALLS}
    base = {k: sum(v) / len(known) for k, v in came.items()}
    balls = [k for k in boosting.BALLS if 0 < base[k] < 1]
    score = {i: {k: math.log(base[k] / (1 - base[k])) for k in balls} for i in [*known, step - 1]}
    for _ in range(st.trees):
        p = {i: {k: 1 / (1 + math.exp(-score[i][k])) for k in balls} for i in known}
        sums = lambda some: {k: (sum(p[i][k] - came[k][i - 5] for i in some), sum(p[i][k] * (1 - p[i][k]) for i in some)) for k in balls}  # noqa: E731, B023
        worth = lambda some: sum(g * g / (h + st.ridge) for g, h in sums(some).values()) / 2  # noqa: E731, B023
        leaves = [(known, [])]
        for _ in range(st.depth):
            grown = []
            for own, path in leaves:
                best, at = 1e-9, (0, st.bins - 1)
                for f in range(3):
                    for b in range(st.bins):
                        left, right = [i for i in own if bins[i][f] <= b], [i for i in own if bins[i][f] > b]
                        if min(len(left), len(right)) >= st.least and worth(left) + worth(right) - worth(own) > best + 1e-12:
                            best, at = worth(left) + worth(right) - worth(own), (f, b)
                f, b = at
                grown += [([i for i in own if bins[i][f] <= b], [*path, (f, b, True)]), ([i for i in own if bins[i][f] > b], [*path, (f, b, False)])]
            leaves = grown
        for own, path in leaves:
            move = {k: -st.rate * g / (h + st.ridge) for k, (g, h) in sums(own).items()}
            for i in [*known, step - 1]:
                if all((bins[i][f] <= b) == low for f, b, low in path):
                    for k in balls:
                        score[i][k] += move[k]
    return {k: 1 / (1 + math.exp(-score[step - 1][k])) for k in balls}


def test_equals_plain_boosting(spark, history):
    rows, d = history
    st = boosting.Settings(trees=2, depth=2, bins=5, rate=0.5, least=8)
    got = boosting.BoostScorer(FEATURES, st).probabilities(spark, d, 107, 108).collect()
    for step in (107, 108):
        own = {(r.color, r.ball): r.prob for r in got if r.step == step}
        want = plain(rows, step, 107, st)
        assert set(own) == set(want) and ("red", 1) not in own and ("red", 33) not in own and ("blue", 16) not in own
        assert own == pytest.approx(want, rel=1e-9)
        assert len({round(p, 9) for p in own.values()}) > 20


def test_steps_do_not_see_what_follows(spark, history):
    _, d = history
    st = boosting.Settings(trees=1, depth=1, bins=4, least=5)
    both = boosting.BoostScorer(FEATURES, st, at_once=1).probabilities(spark, d, 108, 109).collect()
    cut = boosting.BoostScorer(FEATURES, st).probabilities(spark, d.where("idx < 108"), 108, 108).collect()
    assert sorted(cut) == sorted(r for r in both if r.step == 108)


def test_jobs_do_not_grow_with_balls_or_steps(spark, history):
    _, d = history
    scorer = boosting.BoostScorer(FEATURES, boosting.Settings(trees=1, depth=2, bins=4, least=5))
    _, rows, _ = scorer.prepared(spark, d, 100)

    def jobs(first, last):
        forests = scorer.start(spark, d, first, last)
        spark.sparkContext.setJobGroup(f"fit-{first}", "")
        scorer.fit(spark, rows, forests)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{first}"))

    assert jobs(101, 101) == jobs(100, 109)


def test_in_the_backtest_and_early_steps(spark, history):
    _, d = history
    scorer = boosting.BoostScorer(settings=boosting.Settings(trees=1, depth=1))
    with files.cleared(spark):
        bets = backtest.backtest(spark, d, TUNED, 110, periods=2, scorer=scorer)
        assert sorted(r.step for r in bets.select("step").distinct().collect()) == [108, 109]
        early = scorer.probabilities(spark, d, 1, 9).collect()
    assert {r.step for r in early} <= set(range(7, 10)) and all(0 < r.prob < 1 for r in early)
    assert scorer.features == draws.FEATURES


def test_null_features_of_the_first_rows(spark, history):
    rows, d = history
    scorer = boosting.BoostScorer(["blue_lag1", "blue_ma5"])
    data = draws.features(d).select("idx", "blue_lag1", "blue_ma5")
    got = {r.idx: (r.blue_lag1, r.blue_ma5) for r in scorer.last_rows(data, 1, 7).collect()}
    assert got[0] == (0, 0) and got[3] == (rows[2][2], 0)
    assert got[6] == (rows[5][2], sum(rows[k][2] for k in range(1, 6)) / 5)


def test_prefix_scorer_takes_no_rows(spark, history):
    _, d = history
    none = d.where("idx < 0")
    assert scoring.SqlScorer().probabilities(spark, none, 0, 0).count() == 0
