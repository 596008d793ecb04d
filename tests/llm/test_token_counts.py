from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ballast.llm import token_counts as tc

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["one two\n\n\nthree\n  four", "", None, "\n", "\n\n\n\n\n\n\n\n", "é ü\n😀😀 x\n", "no line end", "a\r\nb\rc", "word " * 4000 + "\n" + "tail\n" * 50, "x\x00\ny"]


def tokens(text):
    """(first byte, byte after) of each token by another library."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, out = 0, []
    for x in t.encode(text, add_special_tokens=False).tokens:
        n = len(x)  # one character a byte
        out.append((at, at + n))
        at += n
    assert at == len(text.encode())
    return out


def brute(text, rule):
    text = text or ""
    lines = text.split("\n")
    parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or not text else [])
    at, spans = 0, []
    for p in parts:
        spans.append((at, at + len(p.encode())))
        at += len(p.encode())
    got = [Fraction(0)] * len(parts)
    for a, z in tokens(text) if text else []:
        share = [max(0, min(z, y) - max(a, x)) for x, y in spans]
        touched = [i for i, s in enumerate(share) if s]
        if rule == "first":
            got[touched[0]] += 1
        elif rule == "last":
            got[touched[-1]] += 1
        elif rule == "most":
            got[max(touched, key=lambda i: (share[i], -i))] += 1
        else:
            for i in touched:
                got[i] += Fraction(share[i], z - a)
    return [(len(p), float(g)) for p, g in zip(parts, got)]


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_equal_brute_force(spark, rule):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    by = defaultdict(list)
    for r in tc.section_token_counts(df, PATH, PATTERN, rule).collect():
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        rows = sorted(by[i], key=lambda r: r.section)
        want = brute(t, rule)
        assert [r.length for r in rows] == [n for n, _ in want]
        assert np.allclose([r.n_tokens for r in rows], [g for _, g in want])
        assert [r.section for r in rows] == list(range(len(want)))
        assert abs(sum(r.n_tokens for r in rows) - rows[0].doc_tokens) < 1e-6
        assert "".join((t or "")[r.start : r.start + r.length] for r in rows) == (t or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=30), st.lists(st.integers(0, 60), max_size=8), st.sampled_from(tc.RULES))
def test_every_token_is_allocated_once(widths, cuts, rule):
    ends = np.cumsum(widths).astype(np.int64)
    n = int(ends[-1]) if widths else 0
    borders = np.array([0, *sorted(min(c, n) for c in cuts), n])
    got = tc.allocate(ends, borders, rule)
    assert abs(got.sum() - len(widths)) < 1e-9 and len(got) == len(borders) - 1


def test_fields_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab", None, "cd"), (2, None, None, None), (None, "x", "y", "z")], "doc_id long, a string, b string, c string")
    rows = tc.section_token_counts(df, PATH, PATTERN, "split", fields=["a", "b", "c"]).collect()
    assert [(r.doc_id, r.section, r.length) for r in rows] == [(1, 0, 2), (1, 1, 0), (1, 2, 2), (2, 0, 0), (2, 1, 0), (2, 2, 0), (None, 0, 1), (None, 1, 1), (None, 2, 1)]
    assert tc.section_token_counts(df.limit(0), PATH, PATTERN, fields=["a"]).count() == 0
    with pytest.raises(ValueError):
        tc.section_token_counts(df, PATH, PATTERN, "none")
