import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ballast.llm import maxent
from ballast.llm._shared import Scratch
from ballast.llm._words import words

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]


def out_of_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def rows_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "no name " * 30), (903, "same\x0bÉ text"), (903, "same\x0bÉ text"), (904, "loop " * 4000)]


def test_base_equals_brute_force_and_model_beats_it(spark):
    rows = rows_of(spark)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in maxent.score_documents(spark, df).collect()), key=str)
    count = Counter(x for i, t in rows if i is not None and not out_of_training(i) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, out_of_training(i), len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    want.sort(key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held) + 0.1 * sum(r[2] for r in held)
    assert all(r[6] < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    model, counts = maxent.train_model(Scratch(spark), df)
    count = Counter(x for r in df.collect() for x in tokens(r.text))
    w = words(pa.array([" ".join(x for x in count if x)]), lower=True)
    h, c, first = model.tokens(w)
    share, seen = Counter(), Counter()
    for x, k in zip([w.word(i).decode() for i in range(len(w.start))] + [None], c):
        share[int(k)] += (count[x] + 1) / 10 ** model.log_z[k]
        seen[int(k)] += 1
    assert len(share) > 100
    for k, s in share.items():
        # a cell of one word has all of its share; any other keeps one part for unseen words
        single = k == maxent.END or k in model.single_cell
        assert not single or seen[k] == 1
        assert abs(s + (0 if single else 10 ** -model.log_z[k]) - 1) < 1e-9
    rows = model.rows_of(*model.contexts(h, c, first))
    assert np.allclose(np.exp(model.log_classes(rows)).sum(axis=1), 1, atol=1e-4)
    for k in range(maxent.CLASSES):
        assert np.allclose(np.exp(model.log_cells(rows, np.full(len(h), k))).sum(axis=1), 1, atol=1e-4)
    assert counts.count() == len(count) - 1 and model.n == sum(count.values()) and model.v == len(count)


def no_words(n=0, v=0, n_end=0, head=np.zeros(0, np.uint64), count=np.zeros(0)):
    cells = maxent.CLASSES * maxent.CELLS
    return maxent.Model(head, count, np.zeros(0, np.uint64), np.zeros(0, int), np.full(maxent.ENDINGS, 20), np.zeros(cells), np.zeros(cells), n, v, n_end)


def test_gradient_steps_lower_the_loss():
    """Of both factors: what the class and what the cell within it are depends on the word before."""
    r = np.random.default_rng(0)
    m = no_words()
    rows = np.stack([r.integers(0, 40, 20000) for i in range(4)]).astype(np.uint16)
    cell = rows[0].astype(int) % maxent.CLASSES * maxent.CELLS + rows[1] % 7
    loss = lambda: (-m.log_classes(rows)[np.arange(20000), cell // maxent.CELLS].mean(), -m.log_cells(rows, cell // maxent.CELLS)[np.arange(20000), cell % maxent.CELLS].mean())
    before = loss()
    for _ in range(3):
        m.train(rows, cell, 2.0)
    assert all(x < 0.5 * y for x, y in zip(loss(), before))


def softmax(x):
    top = max(x)
    total = sum(math.exp(v - top) for v in x)
    return [math.exp(v - top) / total for v in x]


def test_score_equals_brute_force(spark):
    """The whole score of a small table, token by token in plain Python: dictionaries of weights, one event at a time."""
    r = random.Random(2)
    vocab = [f"{a}{b}" for a in ("the", "of", "Ab", "xy", "qu", "é") for b in ("", "ing", "ed", "s", "ly", "a1")]
    rows = [(i, " ".join(r.choices(vocab, k=r.randrange(0, 120)))) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    m, _ = maxent.train_model(Scratch(spark), df.where(~maxent.held_out_id(df.doc_id)))
    count = Counter(x for i, t in rows if not out_of_training(i) for x in tokens(t))
    events = []
    for i, t in rows:
        h, c, first = m.tokens(words(pa.array([t]), lower=True))
        one, two = [1, *h[:-1].tolist()], [2, 2, *h[:-2].tolist()][: len(h)]
        for k, x in enumerate(tokens(t)):
            c1, c2 = (c[k - 1] if k else 256), (c[k - 2] // 16 if k > 1 else 16)
            keys = m.rows_of(np.array([one[k]], np.uint64), np.array([two[k]], np.uint64), np.array([c1 * 17 + c2]))
            within = m.cell_rows(keys, np.array([c[k] // 16]))
            events.append((i, x, int(c[k]), [(f, int(v)) for f, v in enumerate(keys[:, 0])], [(f, int(v)) for f, v in enumerate(within[:, 0])]))
    w, u, seen_w, seen_u = {}, {}, Counter(), Counter()

    def p_class(e):
        return softmax([m.bias[j] + sum(w.get(k, [0] * 16)[j] for k in e[3]) for j in range(16)])

    def p_cell(e):
        return softmax([m.cell_bias[e[2] // 16][j] + sum(u.get(k, [0] * 16)[j] for k in e[4]) for j in range(16)])

    learnt = [e for e in events if not out_of_training(e[0])]
    assert 2000 < len(learnt) < 4096  # one batch: all gradients at the starting weights
    for table, seen, at, p, y in ((w, seen_w, 3, p_class, lambda e: e[2] // 16), (u, seen_u, 4, p_cell, lambda e: e[2] % 16)):
        sums = {}
        for e in learnt:
            g = p(e)
            g[y(e)] -= 1
            for k in e[at]:
                seen[k] += 1
                sums[k] = [a + b for a, b in zip(sums.get(k, [0] * 16), g)]
        for k, g in sums.items():
            table[k] = [-x * 2.0 / (20 + seen[k]) ** 0.75 for x in g]
    want = Counter()
    n_cell, v_cell = Counter(), Counter()
    for x, c in {e[1]: e[2] for e in learnt}.items():
        n_cell[c] += count[x]
        v_cell[c] += 1
    for e in events:
        single = e[2] == 0 or e[2] in m.single_cell
        z = n_cell[e[2]] + 1 if single else n_cell[e[2]] + v_cell[e[2]] + 1
        want[e[0]] += math.log10(p_class(e)[e[2] // 16]) + math.log10(p_cell(e)[e[2] % 16]) + math.log10((count[e[1]] + 1) / z)
    got = {x.doc_id: x.score for x in maxent.score_documents(spark, df).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i])) for i in want)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = maxent.score_documents(spark, df).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 2
    assert all(math.isfinite(r.score) for r in rows)
    assert maxent.score_documents(spark, df.limit(0)).count() == 0


def test_weight_rows_grow_with_the_input_and_no_shard_with_a_word():
    r = np.random.default_rng(1)
    h = np.sort(r.integers(3, 1 << 60, 1000).astype(np.uint64))
    made = lambda n, count: no_words(n, 1000, 10, h, count)
    assert [made(n, np.ones(1000)).shards for n in (10, maxent.SHARD, 40 * maxent.SHARD)] == [1, 1, 40]
    count = np.full(1000, 1000.0)
    count[7] = 5 * maxent.SHARD  # a very common word, mostly after itself
    m = made(40 * maxent.SHARD, count)
    one, two = h[r.integers(0, 1000, 60000)], h[r.integers(0, 1000, 60000)]
    one[:30000] = two[:20000] = h[7]
    salt = r.integers(0, 1 << 60, 60000).astype(np.uint64)
    s = m.shard(one, two, salt)
    assert np.bincount(s[:30000], minlength=40).max() < 4500
    rare = one != h[7]
    assert len(set(zip(one[rare], s[rare]))) == len(set(one[rare]))


def test_shards_score_as_one_process_does(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    some = maxent.train_model(Scratch(spark), df.where(~maxent.held_out_id(df.doc_id)))[0]
    texts = pa.array([t for _, t in rows])
    h, c, first = some.tokens(words(texts, lower=True))
    one, two, pair = some.contexts(h, c, first)
    doc = np.repeat(np.arange(len(rows)), np.diff(first))
    learnt = np.array([not out_of_training(i) for i, _ in rows])[doc]
    events = maxent.pack(some.rows_of(one, two, pair), c, learnt)
    for got, put in zip(maxent.unpack(events), (some.rows_of(one, two, pair), c, learnt)):
        assert (got == put).all()
    for size in (maxent.SHARD, some.n // 5):
        monkeypatch.setattr(maxent, "SHARD", size)
        # words of one shard each, so that the shards do not depend on how the input is sliced
        monkeypatch.setattr(maxent.Model, "spread", lambda m: m.__dict__.update(shards=max(1, -(-m.n // maxent.SHARD)), hot=np.zeros(0, np.uint64), parts=np.zeros(0, int)))
        some.spread()
        assert some.shards == (1 if size > some.n else -(-some.n // (some.n // 5)))
        shard = some.shard(one, two, one)
        lp = np.empty(len(h))
        for s in set(shard):
            at = np.flatnonzero(shard == s)
            some.clear()
            rows_at, c_at, _ = maxent.unpack(events[at])
            some.train(rows_at[:, learnt[at]], c_at[learnt[at]], 2.0)
            lp[at] = some.log_p(rows_at, c_at)
        want = np.add.reduceat(lp / math.log(10) - some.log_z[c], first[:-1])
        got = {r.doc_id: r.score - r.base_score - r.n_tokens * math.log10(some.n + some.v + 1) for r in maxent.score_documents(spark, df).collect()}
        assert np.allclose([got[i] for i, _ in rows], want, rtol=1e-3)
