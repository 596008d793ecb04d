import hashlib
import random
import re

import numpy as np

from ballast.llm import repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                s = tuple(w[k : k + window])
                least[s] = min(least.get(s, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return sorted(out, key=str)


def corpus(window, n=150, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(300)]
    shared = [r.choices(vocab, k=k) for k in (window, window + 7, window - 1, 3 * window)]
    rows = []
    for i in range(n):
        w = r.choices(vocab, k=r.choice((0, 3, window - 1, window, 2 * window, 4 * window)))
        if r.random() < 0.5:
            w = w + r.choice(shared) + r.choices(vocab, k=r.randrange(20))
        if rows and r.random() < 0.3:
            w = WORD.findall(r.choice(rows)[1])
            if r.random() < 0.6 and w:
                w[r.randrange(len(w))] = "edited"
        rows.append((i * 2, r.choice((" ", "  ", "\n")).join(w)))
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, n int, phrases string, n_words int")


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for k in (1, 2, 3, 43, 64, 200):
        assert repeats.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(200 - k + 1)]
    assert len(repeats.sliding_min(x, 201)) == 0


def test_automaton_finds_every_occurrence():
    w = "a b a b a bb a b a".split()
    assert repeats.occurrences(repeats.automaton(["a b", "b a"]), w, 2).tolist() == [0, 1, 2, 3, 6, 7]
    assert repeats.occurrences(repeats.automaton([]), w, 2).tolist() == []


def test_report_equals_brute_force(spark):
    for window, phrase in ((50, 8), (12, 4)):
        rows = corpus(window) + [(900, None), (902, ""), (904, " \n"), (None, "x " * 80), (906, "x " * 80), (908, "x " * 70), (908, "y " * 60), (910, "y " * 60), (912, "loop them all " * 3000), (914, "loop them all " * 2999)]
        rows += rows[:3]
        got = sorted((tuple(r) for r in repeats.removal_report(spark, frame(spark, rows), window, phrase).collect()), key=str)
        assert got == sorted((x[:4] for x in brute(rows, window)), key=str)


def test_removal_keeps_columns_and_clean_texts(spark):
    rows = corpus(12, seed=9) + [(901, None), (903, "")]
    want = {x[0]: x for x in brute(rows, 12)}
    df = frame(spark, rows)
    got = repeats.remove_repeats(spark, df, 12, 4)
    assert got.columns == df.columns
    got = {r.doc_id: r.text for r in got.collect()}
    texts = dict(rows)
    for i, (_, n, gone, _, kept) in want.items():
        if gone == 0:
            assert got[i] == texts[i]
        elif kept:
            assert got[i] == kept
        else:
            assert n == gone and i not in got


def test_the_automata_decide(spark, monkeypatch):
    """Without its automata the operator finds nothing but whole copies."""
    rows = corpus(12, seed=4)
    monkeypatch.setattr(repeats, "automaton", lambda texts: [])
    whole = {i for i, n, gone, *_ in brute(rows, 12) if n == gone}
    got = repeats.removal_report(spark, frame(spark, rows), 12, 4).collect()
    assert any(0 < x[2] < x[1] for x in brute(rows, 12))
    assert all(r.n_removed in (0, r.n_words) and (not r.n_removed or r.doc_id in whole) for r in got)


def test_many_shards_give_the_same(spark):
    rows = corpus(12, seed=5)
    for shard_bytes in (64, 1 << 20):
        got = sorted((tuple(r) for r in repeats.removal_report(spark, frame(spark, rows), 12, 4, shard_bytes=shard_bytes).collect()), key=str)
        assert got == sorted((x[:4] for x in brute(rows, 12)), key=str)


def test_texts_of_one_doc_id_keep_their_own_remainders(spark):
    base = " ".join(f"b{i}" for i in range(12))
    rows = [(1, base), (2, f"head {base} tail"), (2, "clean words here"), (3, base), (3, "clean too"), (3, "clean too"), (None, base)]
    got = repeats.remove_repeats(spark, frame(spark, rows), 12, 4).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, base), (1, base), (2, "clean words here"), (2, "head tail"), (3, "clean too"), (3, "clean too")]


def test_clashing_columns(spark):
    df = frame(spark, corpus(12, seed=6)).selectExpr("*", "1 AS _repeat_kept", "2 AS seq", "3 AS _REPEAT_DOC", "4 AS kept_text", "5 AS _kept")
    got = repeats.remove_repeats(spark, df, 12, 4)
    assert got.columns == df.columns and {r[0] for r in got.select("_repeat_kept").collect()} == {1}


def test_empty_table(spark):
    assert repeats.removal_report(spark, frame(spark, [])).count() == 0
