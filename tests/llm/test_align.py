import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ballast.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = [" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "漢字", "\xa0", "\x1c", "\u2003", "'s", "12", "!", "...", "<s>", "<|endoftext|>", "Ab", "\u0301", "😀", "\r\n", "\x00", "<0x0A>", "house", "unbelievable"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(both, text):
    """(ids of A, ids of B, groups) from whole texts by sets of byte offsets."""
    a, b = both
    if not text:
        return [], [], []
    sign = {v: k for k, v in align.byte_level().items()}
    back = {s: i for i, s in sign.items()}
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    wa = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
    wb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    want = (" " + text).encode()
    if b"".join(wa) != want or b"".join(wb) != want:
        return [], [], []
    ends = lambda ws: [sum(map(len, ws[: i + 1])) for i in range(len(ws))]
    ea, eb, groups, start = ends(wa), ends(wb), [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append(([i for i, x in zip(ia, ea) if start < x <= e], [i for i, x in zip(ib, eb) if start < x <= e]))
        start = e
    return ia, ib, groups


def texts(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + [None, "", " ", "\n", "a▁b", "▁", "x" * 3000, "the house " * 400]


@pytest.mark.parametrize("head", [1_000_000, 4])
def test_equals_brute_force(spark, both, head):
    given = texts(250)
    rows = [(i if i % 9 else None, t, "z") for i, t in enumerate(given)] + [(1, given[1], "z"), (1, given[2], "z")]
    found = [(d, *brute(both, t)) for d, t, _ in rows]
    links = [[(g[0][-1], g[1][-1]) for g in f[3]] for f in found]
    n = Counter(x for own in links for x in own)
    top = {}
    for (a, b), k in n.items():
        top[b] = max(top.get(b, 0), k)
    want = []
    for (d, ia, ib, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want.append((d, len(ia), len(ib), len(groups), len(own), sum(n[x] == top[x[1]] for x in own), sum(n[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if ia else ""))
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    out = align.align_documents(spark, df, A, B, head=head)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_groups_cover_the_bytes(spark, both):
    given = [t for t in texts(60, 7) if t]
    rows = align.token_groups(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), A, B).orderBy("doc_id", "start").collect()
    for i, t in enumerate(given):
        own = [r for r in rows if r.doc_id == i]
        assert [(list(r.a_ids), list(r.b_ids)) for r in own] == brute(both, t)[2]
        if own:
            assert own[0].start == 0 and own[-1].end == len((" " + t).encode()) and all(x.end == y.start for x, y in zip(own, own[1:]))


def test_labels_say_which_side_ends(both):
    al = align.Aligner(A, B)
    ids = al.encoded("unbelievable")
    labels = al.labels(*ids)
    assert len(labels) == 13 and labels[-1] == align.BOTH
    assert sum(x in (align.A_END, align.BOTH) for x in labels) == len(ids[0]) and sum(x in (align.B_END, align.BOTH) for x in labels) == len(ids[1])


def test_a_small_memory_gives_the_same(both):
    al, given = align.Aligner(A, B, keep=5), [t for t in texts(80, 3) if t]
    for t in given:
        for cut in al.learn([t]):
            known = [al.new[c] for c in cut]
            want = brute(both, t)
            assert (None in known) == (not want[0])
            if want[0]:
                assert sum(k[0] for k in known) == len(want[0]) and sum(k[2] for k in known) == len(want[2])


def test_frequent_pairs(spark):
    counts = spark.createDataFrame([(i, 1 << (i % 10)) for i in range(100)], "pair long, n long")
    assert align.frequent_from(counts, 100) == 1 and align.frequent_from(counts, 99) == 2
    assert align.frequent_from(counts, 20) == 256 and align.frequent_from(counts, 0) == 1024


def test_empty_table(spark):
    assert align.align_documents(spark, spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
