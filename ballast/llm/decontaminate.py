"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may occur in a document with up to ``budget`` word edits (insertions,
deletions, substitutions). Cut into budget + 1 pieces, at least one piece of such an
occurrence is unedited, so exact piece hits find every one. Around a hit, Myers'
bit-parallel algorithm gives the least edit distance of the item to any run of the
document's words; the item's words are the bits of one integer.

Words here are runs of characters other than ASCII white space and ASCII signs, with A-Z
in lower case, so case, spacing and punctuation do not hide an item.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import _KEPT, new_path, open_file
from ballast.llm._words import slices, window_hash, words

_U = np.uint64
#: ASCII characters that separate words here, besides white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes(0x20 if chr(i) in SIGNS or i < 0x20 or i == 0x7F else i for i in range(256))


def plain_words(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").translate(_PLAIN).lower().split(b" ") if w]


def edit_budget(m: int, percent: int) -> int:
    return m * percent // 100


def pieces(m: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 pieces of nearly equal length."""
    k = budget + 1
    return [(i * m // k, (i + 1) * m // k - i * m // k) for i in range(k)]


def myers(item: list, text: list) -> list[int]:
    """least[j]: the least edit distance of ``item`` to a run of ``text`` that ends before j, for j from 0."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict = defaultdict(int)
    for i, x in enumerate(item):
        where[x] |= 1 << i
    pv, mv, score, out = full, 0, m, [m]
    for c in text:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        pv, mv = (mh << 1 & full) | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


class Items:
    """Items ready for a scan; benchmark_parts() bounds their number."""

    def __init__(self, rows, percent: int, min_words: int):
        self.items = []
        table: dict[int, list] = defaultdict(list)
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            w = plain_words(text or "")
            if len(w) >= max(min_words, 1):
                budget = edit_budget(len(w), percent)
                for start, n in pieces(len(w), budget):
                    table[n].append((w[start : start + n], len(self.items), start))
                self.items.append((item_id, w, budget))
        self.by_length = {}
        for n, found in sorted(table.items()):
            col = words(pa.array([" ".join(p) for p, _, _ in found]))
            key = window_hash(col.hashes(), col.first[:-1], n)
            order = np.argsort(key, kind="stable")
            self.by_length[n] = (key[order], np.array([found[i][1] for i in order]), np.array([found[i][2] for i in order]))

    def matches(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, distance, first word, number of words) of the best occurrence of each item in each row."""
        w = words(pa.array([t.encode("utf-8", "surrogatepass").translate(_PLAIN).lower() if t else b"" for t in column.to_pylist()], pa.binary()))
        h, hits = w.hashes(), defaultdict(set)
        for n, (keys, item, start) in self.by_length.items():
            if len(h) < n:
                continue
            x = window_hash(h, np.arange(len(h) - n + 1), n)
            lo, hi = np.searchsorted(keys, x), np.searchsorted(keys, x, side="right")
            for p in np.flatnonzero(hi > lo):
                d = int(np.searchsorted(w.first, p, side="right")) - 1
                if p + n <= w.first[d + 1]:
                    for q in range(lo[p], hi[p]):
                        hits[d, int(item[q])].add(int(p) - int(start[q]))
        out = []
        for (d, k), begins in sorted(hits.items()):
            _, item, budget = self.items[k]
            lo, hi, best = int(w.first[d]), int(w.first[d + 1]), None
            runs: list[list[int]] = []
            for b in sorted(begins):
                if runs and b - budget <= runs[-1][1]:
                    runs[-1][1] = b + len(item) + budget
                else:
                    runs.append([b - budget, b + len(item) + budget])
            for a, z in runs:
                a, z = max(a, lo), min(z, hi)
                text = [w.word(i).decode("utf-8", "surrogatepass") for i in range(a, z)]
                least = myers(item, text)
                end = min(range(len(least)), key=lambda j: (least[j], j))
                if least[end] <= budget and (best is None or least[end] < best[0]):
                    back = myers(item[::-1], text[:end][::-1])
                    n = min((j for j in range(len(back)) if back[j] == least[end]), default=end)
                    best = (least[end], a + end - n - lo, n)
            if best:
                out.append((d, k, *best))
        return out


class PartFiles:
    """Items of one part of a large benchmark, in files of the shared folder; a task reads them when it needs them."""

    def __init__(self, uris: list[str]):
        self.uris = uris

    @property
    def value(self) -> list[tuple]:
        out = []
        for uri in self.uris:
            with open_file(uri) as f:
                t = pq.read_table(f)
            out += zip(t.column("i").to_pylist(), t.column("t").to_pylist())
        return out


def benchmark_parts(spark: SparkSession, benchmark: DataFrame, max_items: int, max_bytes: int, text_col: str = "text", id_col: str = "item_id") -> list:
    """The items as lists of about ``max_items`` items and ``max_bytes`` bytes at most, one list at least.

    A benchmark within both bounds is one list, broadcast, and its documents are scanned once. A larger one is dealt by a hash
    of its rows into files of the shared folder, which Spark writes and tasks read, a part a scan: no list goes through the
    driver, and a task holds one part. The files stay as a result does.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // max_items), -(-size // max_bytes))
    if parts == 1:
        return [spark.sparkContext.broadcast([tuple(r) for r in items.collect()])]
    path = new_path(spark, "benchmark")
    items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))).repartition("part").write.partitionBy("part").parquet(path)
    _KEPT.append(path)
    files = spark.read.parquet(path).inputFiles()
    return [PartFiles(sorted(f for f in files if f"/part={k}/" in f)) for k in range(parts)]


def _ready(made: dict, held, percent: int, min_words: int) -> Items:
    if "items" not in made:
        made["items"] = Items(held.value, percent, min_words)
    return made["items"]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 15, min_words: int = 1, max_items: int = 100_000, max_bytes: int = 64 << 20, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_words, item_words): a row an item that occurs in a document.

    The best occurrence is reported: least distance, then the first to end, then the shortest.
    Items of fewer than seven words have a budget of none at 15 percent, so they match word for
    word; those of fewer than ``min_words`` match nothing, nor do null or empty texts. Null
    doc_ids are reported as null; repeated rows and items each have their own rows. A text of any length is
    one row's work, its words and piece hashes in memory. An empty
    table on either side gives no rows; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(held) -> DataFrame:
        made: dict = {}

        def run(batches):
            items = _ready(made, held, percent, min_words)
            for b in slices(batches):
                rows = [(b.column(0)[d].as_py(), items.items[k][0], dist, first, n, len(items.items[k][1])) for d, k, dist, first, n in items.matches(b.column(1))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "distance", "first_word", "n_words", "item_words"])

        return src.mapInArrow(run, "doc_id long, item_id long, distance long, first_word long, n_words long, item_words long")

    return reduce(DataFrame.unionByName, map(scan, benchmark_parts(spark, benchmark, max_items, max_bytes)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 15, min_words: int = 1, max_items: int = 100_000, max_bytes: int = 64 << 20, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item occurs, in one scan; rows, columns and nulls otherwise as they are."""
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(docs: DataFrame, held) -> DataFrame:
        made: dict = {}

        def run(batches):
            items = _ready(made, held, percent, min_words)
            for b in slices(batches, at):
                keep = np.ones(b.num_rows, bool)
                keep[sorted({m[0] for m in items.matches(b.column(at))})] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, schema)

    return reduce(clean, benchmark_parts(spark, benchmark, max_items, max_bytes), docs)
