"""Where two tokenizers cut the same bytes: token groups, linked ids, and how often ids are linked.

Both tokenizers encode a space and the text: a byte-level vocabulary A, and a piece vocabulary B that
puts the space there itself. Every byte gets a label: no token ends at it, one of A does, one of
B does, both do. A regular expression scans the label string for the spans up to each both-label, and counting a
span's labels says how many tokens of either side form the group. The two tokens that end at a
both-label are linked.

Neither vocabulary merges across a space between two other characters, so both end a token there: the text
falls into chunks at those spaces, a chunk's labels and groups are the text's own, and each distinct
chunk is encoded and scanned once. A bounded dictionary of two generations keeps
the frequent ones; a test holds the result against encoding whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._encode import _ODD
from ballast.llm._shared import Scratch
from ballast.llm._words import slices

#: Labels of a byte.
NONE, A_END, B_END, BOTH = range(4)
_GROUP = re.compile(b"[\x00-\x02]*\x03")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed.
_OTHER = "\t\x0b\x0c\r" + _ODD


def byte_level() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(moved)}


def chunks(text: str) -> list[str]:
    """The text cut at each space that stands between two characters that are not white space; the spaces are left out."""
    if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER):
        return _CUT.split(text)
    return text.split(" ")


@dataclass(slots=True)
class Group:
    start: int  #: bytes of space + text
    end: int
    a: list[int]
    b: list[int]


class Aligner:
    """Both tokenizers, and what was found for the chunks seen lately."""

    def __init__(self, path_a: str, path_b: str, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        sign = byte_level()
        self.bytes_a = {i: bytes(map(sign.__getitem__, w)) for w, i in self.a.get_vocab(with_added_tokens=True).items() if all(c in sign for c in w)}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.width_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.width_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.width_b = np.array([len(x) for x in self.bytes_b])
        self.keep, self.new, self.old = keep, {}, {}

    def encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and of B, None where they don't spell space + text."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        want = (" " + text).encode("utf-8", "replace")
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
        return (a, b) if same else None

    def labels(self, a: list[int], b: list[int]) -> bytes:
        """The label of each byte."""
        ends = np.cumsum(self.width_a[a])
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] |= A_END
        out[np.cumsum(self.width_b[b]) - 1] |= B_END
        return out.tobytes()

    def scanned(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each span up to a both-label: its end in bytes, and how many tokens of A and of B end by there. The last span ends with the text, as both sides do."""
        labels = self.labels(a, b)
        ends = np.array([m.end() for m in _GROUP.finditer(labels)], np.int64)
        label = np.frombuffer(labels, np.uint8)
        return ends, np.cumsum(label & A_END > 0)[ends - 1], np.cumsum(label & B_END > 0)[ends - 1]

    def _known(self, a: list[int], b: list[int], cuts: list[int]) -> list[tuple]:
        """What is kept of each chunk of a text that was encoded; chunks end at these bytes: (tokens of A, of B, groups, the groups written out, linked pairs)."""
        ends, upto_a, upto_b = self.scanned(a, b)
        links = (np.array(a)[upto_a - 1] << 32 | np.array(b)[upto_b - 1]).astype("<i8")
        sa, sb = list(map(str, a)), list(map(str, b))
        ia, ib = [0, *upto_a.tolist()], [0, *upto_b.tolist()]
        shown = [f"{sa[i] if i + 1 == n else ','.join(sa[i:n])}|{sb[k] if k + 1 == o else ','.join(sb[k:o])}" for i, n, k, o in zip(ia, ia[1:], ib, ib[1:])]
        last = np.searchsorted(ends, cuts, side="right").tolist()
        return [(ia[t] - ia[f], ib[t] - ib[f], t - f, ";".join(shown[f:t]), links[f:t].tobytes()) for f, t in zip([0, *last], last)]

    def _one(self, c: str) -> None:
        ids = self.encoded(c)
        self.new[c] = ids and self._known(*ids, [len(c.encode()) + 1])[0]

    def _learn(self, some: list[str]) -> None:
        """Chunks joined by spaces are a text of just these chunks: they are encoded and scanned together, unless some are not spelt."""
        todo = []
        for c in some:
            if c in self.old:
                self.new[c] = self.old[c]
            elif c[0].isspace() or c[-1].isspace() or len(c) > 1000:
                self._one(c)
            else:
                todo.append(c)
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            if ids := self.encoded(" ".join(part)):
                self.new.update(zip(part, self._known(*ids, np.cumsum([len(c.encode()) + 1 for c in part]))))
            else:
                for c in part:
                    self._one(c)

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The chunks of the texts; what is known of each is in ``new`` from here on."""
        if len(self.new) > self.keep:
            self.old, self.new = self.new, {}
        cut = [chunks(t) if t else [] for t in texts]
        self._learn([c for c in set().union(*cut) if c not in self.new])
        return cut

    def text_groups(self, text: str) -> list[Group]:
        """The groups of one text, with places in the bytes of space + text; none where its tokens don't spell it."""
        own = self.encoded(text) if text else None
        if not own:
            return []
        ends, upto_a, upto_b = ([0, *x.tolist()] for x in self.scanned(*own))
        return [Group(ends[i], ends[i + 1], own[0][upto_a[i] : upto_a[i + 1]], own[1][upto_b[i] : upto_b[i + 1]]) for i in range(len(ends) - 1)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids): a row a token group, start and end in bytes of space + text. Texts without tokens have no rows."""

    def run(batches):
        al = _aligner(path_a, path_b)
        for b in slices(batches):
            rows = [(d, g.start, g.end, g.a, g.b) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for g in al.text_groups(t or "")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "end", "a_ids", "b_ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, linked): linked has the text's distinct id pairs, A's in the upper half of a long, and how often each is linked."""
    pair = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def run(batches):
        al = _aligner(path_a, path_b)
        for b in slices(batches):
            n, digests, found, times = np.zeros((b.num_rows, 4), np.int64), [], [], []
            for d, cut in enumerate(al.learn([t or "" for t in b.column(1).to_pylist()])):
                known = [al.new[c] for c in cut]
                if not known or None in known:
                    digests.append("")
                    found.append(np.zeros(0, np.int64))
                    times.append(np.zeros(0, np.int64))
                    continue
                na, nb, ng, groups, links = zip(*known)
                digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest())
                ids, times_ = np.unique(np.frombuffer(b"".join(links), "<i8"), return_counts=True)
                n[d] = sum(na), sum(nb), sum(ng), times_.sum()
                found.append(ids)
                times.append(times_)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            linked = pa.StructArray.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.concatenate(times).astype(np.int32), pa.int32())], fields=list(pair))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, i]) for i in range(4)), pa.array(digests), pa.ListArray.from_arrays(pa.array(offsets), linked)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked array<struct<pair: long, times: int>>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, is_best): an id pair's links in all texts, and whether no other pair of its B id has more."""
    counts = linked.select(F.inline("linked")).groupBy("pair").agg(F.sum("times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    # a row an id of B's vocabulary at most: some tens of thousands
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach in n, 1 where that is all of them."""
    sizes = {r.e: r.k for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("k")).collect()}  # 63 rows at most
    e, seen = max(sizes, default=0) + 1, 0
    while e > 0 and seen + sizes.get(e - 1, 0) <= most:
        e -= 1
        seen += sizes.get(e, 0)
    return 1 << e


def align_documents(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, head: int = 1_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a row of ``docs``.

    path_a: a byte-level vocabulary of the tokenizers library; path_b: a sentencepiece model. Texts are
    encoded once; their distinct id pairs are a table in the shared folder. Counts by pair are an aggregate, and go back
    to the texts in two joins: the at most ``head`` most frequent pairs by broadcast (12 MB at
    the default), all others by shuffle, where no pair then has more than 2/head of all links. So a pair that every text has
    costs nothing more than a rare one.

    A null or empty text, and one whose joined tokens of either side are not space + text (U+2581 in it),
    has zeros and ''. Null and repeated doc_ids are rows of their own; repeated rows count in the pairs as often as
    they are there; of ties for an id's highest count all are best; a text of any length is one row's work. Other columns are not read. An empty table gives no rows.
    """
    with Scratch(spark) as scratch:
        rows = scratch.written(_aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
        counts = scratch.written(pair_counts(rows), "pairs")
        least = frequent_from(counts, head)
        each = rows.where("n_links > 0").select("row", F.inline("linked"))
        sums = [F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
        found = each.join(F.broadcast(counts.where(F.col("n") >= least)), "pair").groupBy("row").agg(*sums)
        if least > 1:
            rest = each.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
            found = found.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = rows.join(found, "row", "left")
        zero = F.lit(0).cast("long")
        out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
        return scratch.keep(out, "alignment")
