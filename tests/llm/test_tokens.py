import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ballast.llm import packing, token_files
from ballast.llm._encode import WordEncoder
from ballast.llm.queries import _tokenizer

TEXTS = [
    "Hello wörld's it's 123 don't </s> <|endoftext|> I'm  x\x00y", "a b  c\x1cd\x85e f", "", None, "  ", ".", "... 'll ΑΣ ΣΑΣ İstanbul é ﬁ x'S 'S",
    "A.'s b,'t 'tis", "﻿abc ​dd 12ab ab12 it's. don't.", "long " * 9000, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> x<|endoftext|>. <|endoftext|>'s", "ciónque, ÉCHAUX. Straße! naïve's", "same text", "same text",
]


def plain(texts):
    t = Tokenizer.from_file(_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_word_encoder_equals_library():
    assert any(i >= 49406 for ids in plain(TEXTS) for i in ids)  # special tokens in texts are found
    e = WordEncoder(_tokenizer(), keep=3)
    for _ in range(2):
        assert [np.frombuffer(e.ids(x), "<u4").tolist() for x in TEXTS] == plain(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=60))
def test_elias_fano_round_trip(values):
    values.sort()
    e = token_files.EliasFano.encode(values)
    again = token_files.EliasFano.frombytes(e.n, e.low_bits, len(e.high), e.tobytes())
    n = len(values)
    assert again.some(0, n).tolist() == values == [again.select(k) for k in range(n)]
    for a, b in ((n // 3, n // 2), (n // 2, n), (n, n)):
        assert again.some(a, b).tolist() == values[a:b]


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    e = token_files.EliasFano.encode(v)
    assert e.bits < len(v) * (2.1 + np.log2(v[-1] / len(v)))
    assert [e.select(k) for k in (0, 511, 512, 49_999)] == [int(v[k]) for k in (0, 511, 512, 49_999)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, start string, length int")


def test_shards_round_trip(spark):
    rows = [(5 * i - 20, t) for i, t in enumerate(TEXTS)] + [(None, "no name"), (-20, "again")]
    got = [tuple(r) for r in token_files.read_shards(token_files.write_shards(spark, docs(spark, rows[::-1]), _tokenizer(), shards=3)).drop("shard").collect()]
    at, want = 0, []
    tie = {r[0]: r[1] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    for (i, _), ids in zip(order, plain([t for _, t in order])):
        x = np.array([*ids, 2], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_shards(token_files.write_shards(spark, docs(spark, []), _tokenizer())).count() == 0


def test_shard_random_access(spark):
    r = token_files.write_shards(spark, docs(spark, list(enumerate(TEXTS))), _tokenizer(), shards=1).collect()[0]
    shard = token_files.ShardReader(r.uri)
    for k, ids in enumerate(plain(TEXTS)):
        assert (shard.doc_id(k), shard.ids(k).tolist()) == (k, [*ids, 2])


def test_query_reads_offsets_by_select(spark, monkeypatch):
    made = token_files.write_shards(spark, docs(spark, [(i, f"text {i} " * (i % 7)) for i in range(300)]), _tokenizer(), shards=1).collect()[0]
    reader, asked, word = token_files.ShardReader(made.uri), [], token_files.EliasFano._word
    monkeypatch.setattr(token_files.EliasFano, "_word", lambda self, k: asked.append(k) or word(self, k))
    found = [x for part in reader.scan(docs=64, some=100) for x in part]
    assert [(i, at, len(ids)) for i, at, ids in found] == [(k, reader.offset(k), len(reader.ids(k))) for k in range(300)]
    assert {64, 127, 128, 299} <= set(asked)


def test_shards_follow_the_bytes_and_part_equal_ids(spark):
    rows = [(7, f"same id {i} " * 300) for i in range(200)] + [(None, "none " * 500)] * 3
    made = token_files.write_shards(spark, docs(spark, rows), _tokenizer(), shard_bytes=64 << 10).collect()
    assert len(made) > 5 and sum(r.n_docs for r in made) == 203 and max(r.n_docs for r in made) < 80


def test_packing_covers_every_id_once(spark):
    rows = list(enumerate(TEXTS * 3)) + [(None, "x y")]
    want = {i: [*ids, 2] for i, ids in enumerate(plain(TEXTS * 3))}
    for capacity in (4096, 64):
        got = packing.pack_documents(docs(spark, rows), _tokenizer(), capacity=capacity).collect()
        by, seq = defaultdict(list), defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
            seq[r.sequence_id].append(r)
        assert set(by) == {*want, None}
        for i, ids in want.items():
            at = 0
            for r in sorted(by[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        for rs in seq.values():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == rs[0].sequence_length and at <= capacity and at & (at - 1) == 0
    assert packing.pack_documents(docs(spark, []), _tokenizer()).count() == 0


def brute_place(lengths, capacity, cost):
    """Descending pieces, each to the cheapest sequence with room, looked for among all: pieces by sequence, and those that fit nowhere."""
    heads = sorted(((n % capacity, i) for i, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    seqs, over = [[] for _ in range(sum(n for n, _ in heads) // capacity)], []
    for n, i in heads:
        fits = [(sum(map(cost, (m for m, _ in s))), k) for k, s in enumerate(seqs) if sum(m for m, _ in s) + n <= capacity]
        (seqs[min(fits)[1]] if fits else over).append((n, i))
    return seqs, over


@pytest.mark.parametrize("capacity, linear, quadratic", [(64, 1.0, 1 / 64), (32, 0.0, 1.0), (128, 1.0, 0.0)])
def test_place_assigns_as_brute_force(capacity, linear, quadratic):
    r = np.random.default_rng(capacity)
    for _ in range(30):
        lengths = r.integers(1, 2 * capacity, r.integers(1, 60)).tolist()
        seqs, costs = packing.place(lengths, capacity, linear, quadratic)
        want, over = brute_place(lengths, capacity, lambda n: linear * n + quadratic * n * n)
        whole = [s for s in seqs if s and s[0][2] == capacity]
        own = seqs[len([n for n in lengths if n >= capacity]) :][: len(want)]
        left = {i for _, i in over}
        assert [[(n, i) for i, _, n in s if i not in left] for s in own] == want
        assert len(whole) >= sum(n >= capacity for n in lengths)
        assert sorted((i, at + k) for s in seqs for i, at, n in s for k in range(n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
        assert np.allclose(costs, [sum(linear * n + quadratic * n * n for _, _, n in s) for s in seqs])


def test_place_balances_cost():
    lengths = np.random.default_rng(3).integers(1, 900, 2000).tolist()
    seqs, costs = packing.place(lengths, 4096)
    full = [c for s, c in zip(seqs, costs) if sum(n for _, _, n in s) == 4096]
    assert max(full) / min(full) < 1.25
    with pytest.raises(ValueError):
        packing.pack_documents(None, "", capacity=100)
