import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ballast.llm import decontaminate as dc


def plain_distance(item, text):
    """least[j] by the textbook table."""
    col, out = list(range(len(item) + 1)), [len(item)]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(col[i - 1] + (x != c), col[i] + 1, new[i - 1] + 1))
        col = new
        out.append(col[-1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=90), st.lists(st.integers(0, 3), max_size=90))
def test_myers_equals_table(item, text):
    assert dc.myers(item, text) == plain_distance(item, text)


def brute(docs, items, percent, min_words):
    out = set()
    for d, t in docs:
        text = dc.plain_words(t or "")
        for i, s in items:
            item = dc.plain_words(s or "")
            if len(item) >= min_words:
                best = min(plain_distance(item, text))
                if best <= len(item) * percent // 100:
                    out.add((d, i, best))
    return out


def fixture():
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice((2, 5, 9, 20, 41, 70, 130))))) for i in range(25)] + [(90, None), (91, ""), (92, "ÉÜ straße, x y z Q!"), (None, "no id at all here"), (93, items_dup := "a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, items_dup * 40), (None, "zz No id... AT all-here zz"), (3, "éü ÉÜ Straße x y z q")]
    for d in range(4, 120):
        w = r.choices(vocab, k=r.randrange(60))
        for _ in range(r.randrange(3)):
            x = dc.plain_words(r.choice(items)[1] or "")
            for _ in range(r.choice((0, 1, 2, 4, 8))):
                if x:
                    k = r.randrange(len(x))
                    x[k : k + r.randrange(2)] = r.choices(vocab, k=r.randrange(2))
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((d, r.choice((" ", ", ", "\n")).join(w).title()))
    return docs, items


@pytest.mark.parametrize("percent", [0, 15, 30])
def test_matches_equal_brute_force(spark, percent):
    docs, items = fixture()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(spark, df, b, percent).collect()
    want = brute(docs, items, percent, 1)
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
    by, texts = dict(items), dict(docs)
    for r in got:
        run = dc.plain_words(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert plain_distance(dc.plain_words(by[r.item_id]), run)[-1] == r.distance
    kept = dc.drop_contaminated(spark, df, b, percent)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in {x[0] for x in want}), key=str)


def test_empty_tables_and_bound(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminated(spark, docs, items).count() == 1
    assert dc.contaminated(spark, docs.limit(0), items).count() == 0 == dc.contaminated(spark, docs, items.limit(0)).count()


def test_short_items_match_exactly(spark):
    docs = spark.createDataFrame([(1, "say Yes, sir"), (2, "say yet sir"), (3, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "yes sir"), (3, "!"), (4, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(spark, docs, items).collect()) == [(1, 1), (1, 2)]
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(spark, docs, items, min_words=2).collect()) == [(1, 2)]


def test_a_large_benchmark_is_matched_in_parts(spark):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(dc.contaminated(spark, df, b).collect(), key=str)
    parts = dc.benchmark_parts(spark, b, 7, 1 << 20)
    assert len(parts) > 2 and sorted(map(str, (x for p in parts for x in p.value))) == sorted(map(str, items)) and max(len(p.value) for p in parts) < len(items)
    assert whole and sorted(dc.contaminated(spark, df, b, max_items=7).collect(), key=str) == whole == sorted(dc.contaminated(spark, df, b, max_bytes=200).collect(), key=str)
    assert sorted(dc.drop_contaminated(spark, df, b, max_items=7).collect(), key=str) == sorted(dc.drop_contaminated(spark, df, b).collect(), key=str)


def test_very_long_texts_and_clashing_columns(spark):
    r = random.Random(3)
    item = " ".join(f"item{i}" for i in range(20))
    noise = " ".join(f"w{r.randrange(50)}" for _ in range(300_000))
    near = item.replace("item4 ", "").replace("item9", "other")
    docs = [(1, f"{noise} {near} {noise[:999]}"), (2, noise), (3, "x" * 3_000_000 + " " + item)]
    df = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in docs], "doc_id long, text string, item_id string, distance int, first_word long")
    b = spark.createDataFrame([(7, item, "b")], "item_id long, text string, doc_id string")
    assert sorted((x.doc_id, x.item_id, x.distance, x.first_word) for x in dc.contaminated(spark, df, b).collect()) == [(1, 7, 2, 300_000), (3, 7, 0, 1)]
    assert [x.doc_id for x in dc.drop_contaminated(spark, df, b).select(df.columns).collect()] == [2]
