import random
import re
from itertools import permutations

import pytest

from ballast.llm import filter_audit as fa

DOC = "doc_id long, text string, lang string, source string, part string, n long"


def brute(docs, labels):
    fails = []
    for d, t, source in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        e = d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e}
        fails.append((source or "", bad, any(i == d and q == 1 for i, q, _ in labels if d is not None), any(i == d and x == 1 for i, _, x in labels if d is not None)))
    out = []
    for part in {f[0] for f in fails}:
        own, worth, rows = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0), []
        for p in permutations("ABCDE"):
            for k in range(5):
                x = p[k]
                here = [f for f in own if f[1][x] and not any(f[1][y] for y in p[:k])]
                worth[x] += len(here)
                rows.append((part, "".join(p), k + 1, sum(not any(f[1][y] for y in p[: k + 1]) for f in own), len(here), sum(f[1][x] for f in own) - len(here), sum(f[1][x] and sum(f[1].values()) == 1 for f in own), sum(f[2] for f in here), sum(f[3] for f in here), x))
        out += [(*r[:-1], worth[r[-1]]) for r in rows]
    return sorted(out)


def words(r, n):
    return " ".join(r.choice(["one", "Two", "three\n", "FOUR", "#", "x%", f"w{r.randrange(99)}"]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [None, "", " \n\t", "ÄÖ É" * 30, "plain word " * 60, " ".join(f"w{i}" for i in range(80)), "A" + "b" * 19, "A" + "b" * 18, "a\x0bb\x0cc\x85d\xa0e", *(words(r, r.randrange(1, 120)) for _ in range(12))]
    docs = [(r.choice([None, *range(40)]), r.choice(pool), r.choice([None, "", "s0", "s0", "s1"])) for _ in range(150)]
    labels = [(r.choice([None, *range(50)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(40)]
    df = spark.createDataFrame([(d, t, "en", s, "clash", 1) for d, t, s in docs], DOC)
    out = fa.audit(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == brute(docs, labels)


def test_boundaries(spark):
    w = lambda n, distinct: " ".join([f"w{i}" for i in range(distinct)] + ["w0"] * (n - distinct))
    cases = [(1, w(50, 50), ""), (2, w(49, 49), "A"), (3, w(100, 65), ""), (4, w(100, 64), "B"), (5, w(50, 50) + " " + "A" * 5 + "b" * 5, ""), (6, w(50, 50) + "|", "D"), (7, w(50, 50), "E"), (8, "Z" * 5 + "z" * 95, "A"), (9, "Z" * 6 + "z" * 94, "AC"), (10, "z" * 2_000_000, "A")]
    df = spark.createDataFrame([(d, t, str(d)) for d, t, _ in cases], "doc_id long, text string, source string")
    flags = {int(r.part): r.flags for r in fa.document_flags(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    for d, _, want in cases:
        assert flags[d] == sum(1 << "ABCDE".index(x) for x in want), d


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(spark, spark.createDataFrame([], "doc_id long, text string, source string"), labels).count() == 0
    rows = fa.audit(spark, spark.createDataFrame([(1, "x", None)], "doc_id long, text string, source string"), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}


def test_copies_meet_the_orders_as_one_row(spark):
    df = spark.createDataFrame([(i, "same text", "s") for i in range(500)], "doc_id long, text string, source string")
    assert fa.document_flags(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 2
