import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ballast.llm._shared import Scratch
from ballast.llm import _words, components, near_dup

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingle_set(text, width=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent):
    """Components and set sizes by comparing every pair."""
    sets = [shingle_set(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if rows[x][0] is not None and rows[y][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(rows[x][0]), root(rows[y][0])))
                up[q] = p
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def corpus(n=260, seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    texts = []
    for k in range(n):
        if texts and r.random() < 0.6:
            w = WORD.findall(r.choice(texts[: n // 8] or texts))
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5, 9))):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(r.choice((" ", "  ", "\n", "\t ")).join(w))
        else:
            texts.append(" ".join(r.choices(vocab, k=r.choice((1, 3, 4, 5, 6, 30, 60, 90, 200)))))
    return texts


def test_words_and_hashes_against_re():
    texts = ["a b  c", "", None, "x", " lead", "trail ", "é\x0bü\x1cz A", "one", "two three", "a b  c"] + corpus(40)
    w = _words.words(pa.array(texts)[1:], lower=True)
    want = [WORD.findall(lower(t or "")) for t in texts[1:]]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [w.word(i).decode() for i in range(len(flat))] == flat
    by = {}
    for h, x in zip(w.hashes().tolist(), flat):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    h, at = _words.shingles(w.hashes(), w.first, 3)
    by = {}
    for x, i in zip(h.tolist(), at.tolist()):
        assert by.setdefault(x, tuple(flat[i : i + 3])) == tuple(flat[i : i + 3])


def test_signature_is_circulant_and_estimates_jaccard():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 1300).astype(np.uint64)
    a, b = pool[:1000], pool[300:]
    s = near_dup.signatures(np.concatenate((a, b)), np.array([0, 1000]), 512)
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.08
    y = np.empty(len(a), np.uint32)
    assert s[0, 10] == near_dup._pi(near_dup.sigma(a) - np.uint32(11), y).min()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7), (200, 201), (201, 202), (300, 300), (None, 4), (201, 200)] + [(500, 501 + i) for i in range(50)]
    got = {r.node: r.component for r in components.connected_components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 1, 200: 200, 201: 200, 202: 200, **{500 + i: 500 for i in range(51)}}
    assert components.connected_components(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = corpus() + ["", None, "  ", "one", "ONE", "two words", "word " * 6000, "word " * 5999, "a b c d", "a b c d e"]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)] + [(None, texts[0]), (-50, texts[1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, rep string")
    got = sorted((tuple(r) for r in near_dup.near_duplicates(spark, df, percent=percent).collect()), key=str)
    assert got == brute(rows, percent)


def test_outliers_of_one_bucket_still_find_each_other(spark):
    """Near copies too far from the centre, yet near one another."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for g in range(6):
        w = base[:]
        for k in range(5):
            w[r.randrange(200)] = f"g{g}k{k}"
        for _ in range(3):
            v = w[:]
            v[r.randrange(200)] = "z"
            texts.append(" ".join(v))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in near_dup.near_duplicates(spark, df, percent=85).collect()), key=str) == brute(rows, 85)


def test_empty_table(spark):
    assert near_dup.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_bound_loses_no_more_than_the_bands():
    import math

    for percent in (80, 85, 95):
        m, k = (1 - percent / 100) * 15 / 16, near_dup.most_differences(32, 5, percent)
        above = sum(math.comb(160, i) * m**i * (1 - m) ** (160 - i) for i in range(k + 1, 161))
        assert above <= (1 - (percent / 100) ** 5) ** 32


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_pairs_miss_no_similar_pair(spark, percent):
    """Members of one bucket: a shared template with few or many words of their own, and components that some already have."""
    r = random.Random(percent)
    template = r.sample(range(1 << 40), 120)
    sets = []
    for _ in range(120):
        own = r.sample(range(1 << 40, 1 << 41), r.choice((0, 3, 9, 15, 40)))
        sets.append(sorted({*r.sample(template, r.choice((60, 100, 118, 120))), *own}))
        if r.random() < 0.4:
            sets.append(sorted({*r.sample(sets[-1], len(sets[-1]) - 2), *r.sample(range(1 << 42, 1 << 43), 2)}))
    component = [r.choice((i, i, i - i % 10)) for i in range(len(sets))]
    rows = spark.createDataFrame([(i, component[i], bytearray(np.array(x, np.uint64).tobytes())) for i, x in enumerate(sets)], "node long, component long, set binary")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node long, n long")
    got = {(x.a, x.b) for x in near_dup._prefix_pairs(rows, sizes, percent, "true").collect()}
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if component[i] != component[j]]
    alike = {(i, j) for i, j in every if near_dup.similar(np.array(sets[i], np.uint64), np.array(sets[j], np.uint64), percent)}
    assert alike and alike <= got and len(got) < len(every)


def _sets_and_sizes(spark, found):
    rows = [(i, i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in found]
    sizes = spark.createDataFrame([(i, len(x)) for i, x in found], "node long, n long").distinct()
    return spark.createDataFrame(rows, "node long, component long, set binary"), sizes


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_pairs_of_one_template_do_not_grow_with_its_square(spark, percent):
    """Every document has 340 of a template's 400 shingles and 60 of its own: any two share prefix shingles, but none are similar enough."""
    r = random.Random(7)
    template = range(400)
    found = [(i, {*r.sample(template, 340), *range(1000 * i + 1000, 1000 * i + 1060)}) for i in range(80)]
    rows, sizes = _sets_and_sizes(spark, found)
    assert not any(near_dup.similar(np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64), percent) for i, x in found for j, y in found if i < j)
    assert near_dup._prefix_pairs(rows, sizes, percent, "true").count() <= 80


def test_prefix_pairs_take_each_text_of_a_doc_id_by_itself(spark):
    """Document 1 has one text like document 2's, another with shingles of its own, and the first one twice."""
    a, other = set(range(100)), set(range(1000, 1100))
    rows, sizes = _sets_and_sizes(spark, [(1, a), (1, other), (1, a), (2, {*range(5, 100), 500})])
    assert [tuple(x) for x in near_dup._prefix_pairs(rows, sizes, 80, "true").collect()] == [(1, 2)]
