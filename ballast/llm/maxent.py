"""A hashed maximum-entropy language model with a class-factored softmax.

p(word | before) = p(class | before) * p(cell | class, before) * p(word | cell). Both first
factors are softmaxes whose logits are sums of weight rows, found by hashing features of the
words before: the last word, the one before it (a skip), both together, and the last word's
cell with the class before it; the second factor's rows by these and the class. The end and the
most frequent words are a class, whose cells have a word each; other classes are clusters of
word endings, and their cells hold a frequent word each or a cluster within the class. Clusters
come from what stands next to endings, counted over all training documents. So context tells
apart the frequent words, ten to a class, and the clusters; within a cluster of rarer words the
third factor is (c + 1) / (N + V + 1) (c: the word's count, N: the cell's, V: its distinct
words), so unseen words have a share in every cluster and probabilities sum to 1.

Weights lie in shards, about one for every ``SHARD`` training tokens, each a table of its
own, so that rows grow with the input. The events (a token's weight rows and class, packed in 64
bits) travel to the shard of the word before it, once: the shard's task takes mini-batch
gradient steps over the training events, then scores all events, and sums of a document's
events go back. No weight is sent or averaged: a row learns from every event of its
shard. A word with more than ``SHARD`` / 8 tokens is split over several shards by the word before it,
and pairs of two such words by document too, so that no shard grows with a word's count.
Counts of all words stay in a table; tasks get the counts of the most frequent words, of
fixed size, and the other words' counts come by a join.
"""

from __future__ import annotations

import math
import pickle
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch
from ballast.llm._words import Words, mix, slices, words

_U = np.uint64
ENDINGS, AROUND = 1024, 128
#: Classes, cells of each, and how many cells of a class hold one frequent word.
CLASSES, CELLS, SINGLES = 16, 16, 10
END = 0  # cell of the end, the first of class 0
#: Weight rows of each feature in a shard: last word, skip word, both, cell and class; for the class, and for the cell within it.
ROWS = (1 << 14, 1 << 13, 1 << 16, 1 << 12)
CELL_ROWS = (1 << 15, 1 << 14, 1 << 16, 1 << 15)
_BASE, _CELL_BASE = (np.concatenate(([0], np.cumsum(x))) for x in (ROWS, CELL_ROWS))
#: Training tokens a shard, about.
SHARD = 1 << 21
#: Where a packed event holds its four rows, its cell and whether it is learnt from.
_AT = tuple(map(_U, (0, 14, 27, 43, 55, 63)))
_CHUNK = 1 << 17


def endings(w: Words) -> np.ndarray:
    """A bucket of the last three bytes of each word."""
    x = np.zeros(len(w.start), _U)
    for k in (1, 2, 3):
        at = w.end - k
        x = x * _U(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)].astype(_U) + _U(1), _U(0))
    return (mix(x) >> _U(54)).astype(np.int64)


def _neighbour(bucket: np.ndarray) -> np.ndarray:
    return bucket % AROUND


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, buckets and counts of several slices as one."""
    h, e, n = (np.concatenate(x) for x in zip(*parts))
    u, first, at = np.unique(h, return_index=True, return_inverse=True)
    return u, e[first], np.bincount(at, weights=n).astype(np.int64)


def _count(docs: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(kind, key, bucket, n): kind 0 words by hash, 1 ending followed by, 2 ending preceded by, 3 documents.

    A task combines its slices' words up to ``most`` of them before they leave it.
    """

    def run(batches):
        around, n_docs, held, size = np.zeros((2, ENDINGS, AROUND), np.int64), 0, [], 0
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        row = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "key", "bucket", "n"])
        said = lambda u, e, n: row(np.zeros(len(u), np.int32), u.view(np.int64), e.astype(np.int32), n)
        for b in slices(batches, 1, 2 << 20):
            w = words(b.column(1), lower=True)
            h, e = w.hashes(), endings(w)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, e[first], n))
            size += len(u)
            if size > most:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield said(*held[0])
                    held, size = [], 0
            same = np.flatnonzero(np.diff(w.doc) == 0) if len(h) else np.zeros(0, np.int64)
            np.add.at(around[0], (e[same], _neighbour(e[same + 1])), 1)
            np.add.at(around[1], (e[same + 1], _neighbour(e[same])), 1)
            n_docs += b.num_rows
        if held:
            yield said(*_merged(held))
        for k in (0, 1):
            cells = np.flatnonzero(around[k])
            yield row(np.full(len(cells), k + 1, np.int32), cells, np.zeros(len(cells), np.int32), around[k].ravel()[cells])
        yield row([3], [0], [0], [n_docs])

    return docs.mapInArrow(run, "kind int, key long, bucket int, n long").groupBy("kind", "key").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n"))


def clusters(cells: np.ndarray, k: int, steps: int = 25) -> np.ndarray:
    """A cluster of each ending, by k-means on the roots of the shares of what stands around it; mass-weighted."""
    mass = cells.sum(axis=1)
    x = np.sqrt(cells / np.maximum(mass, 1)[:, None])
    live = np.flatnonzero(mass)
    if not len(live):
        return np.zeros(len(cells), np.int64)
    centres = [x[live[np.argmax(mass[live])]]]
    far = ((x[live] - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(live)):
        centres.append(x[live[np.argmax(far * mass[live])]])
        far = np.minimum(far, ((x[live] - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(steps):
        at = (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)
        at = at.argmin(axis=1)
        for j in range(len(c)):
            if (m := mass * (at == j)).sum():
                c[j] = (x * m[:, None]).sum(axis=0) / m.sum()
    return at


class Model:
    """What every task gets: head words with counts, classes and cells; and the weights of one shard, which start at 0."""

    def __init__(self, head: np.ndarray, head_count: np.ndarray, singles: np.ndarray, single_cell: np.ndarray, ending_cell: np.ndarray, log_z: np.ndarray, n_cell: np.ndarray, n: int, v: int, n_end: int):
        order = np.argsort(head)
        self.head, self.head_log = head[order], np.log10(head_count[order] + 1.0)
        order = np.argsort(singles)
        self.singles, self.single_cell = singles[order], single_cell[order]
        self.ending_cell, self.log_z, self.n, self.v, self.n_end = ending_cell, log_z, n, v, n_end
        seen = n_cell.reshape(CLASSES, CELLS) + 1e-3
        self.bias = np.log(seen.sum(axis=1) / seen.sum()).astype(np.float32)
        self.cell_bias = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
        self.spread()
        self.clear()

    def clear(self) -> None:
        self.w, self.u = (np.zeros((sum(x), n), np.float32) for x, n in ((ROWS, CLASSES), (CELL_ROWS, CELLS)))
        self.seen, self.cell_seen = (np.zeros(sum(x), np.int64) for x in (ROWS, CELL_ROWS))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("w", "u", "seen", "cell_seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.clear()

    def spread(self, shard: int | None = None) -> None:
        """Sets the number of shards, and over how many each frequent word is split; 1 and 2 stand for no word before."""
        shard = shard or SHARD
        self.shards = max(1, -(-self.n // shard))
        some = max(shard // 8, 1)
        count = np.concatenate(([self.n_end, self.n_end], np.round(10.0**self.head_log) - 1))
        hot = np.flatnonzero(count > some)
        self.hot = np.concatenate((np.array([1, 2], _U), self.head))[hot]
        self.parts = np.ceil(count[hot] / some).astype(np.int64)
        order = np.argsort(self.hot)
        self.hot, self.parts = self.hot[order], self.parts[order]

    def shard(self, one: np.ndarray, two: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard of each token after ``one`` and ``two``; salt: a number of each token's document."""
        part = np.zeros(len(one), _U)
        if len(self.hot):
            split = lambda x: np.where(self.hot[k := np.minimum(np.searchsorted(self.hot, x), len(self.hot) - 1)] == x, self.parts[k], 1)
            n = split(one)
            at = np.flatnonzero(n > 1)
            n, both = n[at].astype(_U), np.minimum(n[at], split(two[at])).astype(_U)
            part[at] = (mix(two[at] * _U(5)) + salt[at] % both) % n
        return (mix(one + part * _U(0xA0761D6478BD642F)) % _U(self.shards)).astype(np.int64)

    def tokens(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash (0: the end) and cell of each token, the first token of each document and of the next."""
        h = w.hashes()
        c = self.ending_cell[endings(w)]
        if len(self.singles):
            k = np.minimum(np.searchsorted(self.singles, h), len(self.singles) - 1)
            c = np.where(self.singles[k] == h, self.single_cell[k], c)
        first = w.first + np.arange(len(w.first))
        at = np.ones(first[-1], bool)
        at[first[1:] - 1] = False
        hs, cs = np.zeros(len(at), _U), np.full(len(at), END)
        hs[at], cs[at] = h, c
        return hs, cs, first

    def contexts(self, h: np.ndarray, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word before each token, the one before that, and a number of the first's cell and the second's class."""
        n = len(h)
        place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        one, two = np.zeros(n, _U), np.zeros(n, _U)
        one[1:], two[2:] = h[:-1], h[:-2]
        c1, c2 = np.full(n, CLASSES * CELLS), np.full(n, CLASSES)
        c1[1:], c2[2:] = c[:-1], c[:-2] // CELLS
        one[place < 1], two[place < 2], c1[place < 1], c2[place < 2] = _U(1), _U(2), CLASSES * CELLS, CLASSES
        return one, two, c1 * (CLASSES + 1) + c2

    def rows_of(self, one: np.ndarray, two: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The four features' rows of each token, each counted from its feature's first."""
        keys = (one, two + _U(0x9E3779B97F4A7C15), one * _U(3) ^ mix(two), cells.astype(_U) * _U(0xD6E8FEB86659FD93))
        return np.stack([(mix(k) & _U(n - 1)).astype(np.uint16) for k, n in zip(keys, ROWS)])

    def cell_rows(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The rows that the cell within class c has by the same features."""
        return np.stack([(mix(r.astype(_U) * _U(CLASSES) + c.astype(_U) + _U(i << 40)) & _U(n - 1)).astype(np.uint16) for i, (r, n) in enumerate(zip(rows, CELL_ROWS))])

    def log_classes(self, rows: np.ndarray) -> np.ndarray:
        """Natural logarithms of class probabilities, a row a token."""
        x, _, total = _exponents(self.bias, self.w, _BASE, rows)
        return x - np.log(total)[:, None]

    def log_cells(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same of the cells within class c of each token."""
        x, _, total = _exponents(self.cell_bias[c], self.u, _CELL_BASE, self.cell_rows(rows, c))
        return x - np.log(total)[:, None]

    def log_p(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's cell: both factors."""
        at, c, out = np.arange(len(cell)), cell // CELLS, 0
        for bias, w, base, r, k in ((self.bias, self.w, _BASE, rows, c), (self.cell_bias[c], self.u, _CELL_BASE, self.cell_rows(rows, c), cell % CELLS)):
            x, _, total = _exponents(bias, w, base, r)
            out = out + x[at, k] - np.log(total)
        return out

    def train(self, rows: np.ndarray, cell: np.ndarray, rate: float, batch: int = 16384) -> None:
        for a in range(0, rows.shape[1], batch):
            r, y = rows[:, a : a + batch], cell[a : a + batch]
            at, c = np.arange(len(y)), y // CELLS
            for bias, w, seen, base, f, k in ((self.bias, self.w, self.seen, _BASE, r, c), (self.cell_bias[c], self.u, self.cell_seen, _CELL_BASE, self.cell_rows(r, c), y % CELLS)):
                _, g, total = _exponents(bias, w, base, f)
                g /= total[:, None]
                g[at, k] -= 1
                for i in range(4):
                    _descend(w, seen, base[i], f[i], g, rate)


def _exponents(bias: np.ndarray, w: np.ndarray, base: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits (within what 32-bit floats can raise), their exponentials and these' sums, a row a token."""
    x = w[rows[0] + base[0]] + bias
    for i in range(1, len(rows)):
        x += w[rows[i] + base[i]]
    np.clip(x, -60, 60, out=x)
    e = np.exp(x)
    return x, e, e @ np.ones(e.shape[1], e.dtype)


def _descend(w: np.ndarray, seen: np.ndarray, base: int, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    """A gradient step of the rows: events' gradients summed by row, with a rate that falls by what the row has seen."""
    order = np.argsort(rows, kind="stable")
    s = rows[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    u = s[start] + base
    seen[u] += np.diff(np.concatenate((start, [len(s)])))
    w[u] -= np.add.reduceat(g[order], start, axis=0) * (rate / (20 + seen[u]) ** 0.75)[:, None].astype(np.float32)


def held_out_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


def pack(rows: np.ndarray, cell: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    out = learnt.astype(_U) << _AT[5] | cell.astype(_U) << _AT[4]
    for i in range(4):
        out |= rows[i].astype(_U) << _AT[i]
    return out


def unpack(events: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cells, and which events are learnt from."""
    cut = lambda i: (events >> _AT[i]) & ((_U(1) << (_AT[i + 1] - _AT[i])) - _U(1))
    return np.stack([cut(i).astype(np.uint16) for i in range(4)]), cut(4).astype(np.int64), (events >> _AT[5]) > 0


def _pressed(x: np.ndarray) -> bytes:
    """The array with the bytes of one place together, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)
    return struct.pack("<IB", len(x), x.itemsize) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _restored(b: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<IB", b)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(memoryview(b)[5:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<u{size}").ravel()


def train_model(scratch: Scratch, docs: DataFrame, head_words: int = 1 << 17) -> tuple[Model, DataFrame]:
    """A model of all rows of docs (doc_id, text) as every shard starts from it, and the table (key, n) of all words' counts."""
    counts = scratch.written(_count(docs), "word-counts")
    total = {r.kind: (r.n or 0, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_words, n_distinct = total.get(0, (0, 0))
    n_end = total.get(3, (0, 0))[0]
    by_count = counts.where("kind = 0").groupBy("n").agg(F.count("*").alias("v"))
    # the least count such that no more than head_words words have it or a greater one
    least, upto = None, 0
    for r in sorted(by_count.orderBy(F.desc("n")).limit(head_words).collect(), key=lambda r: -r.n):
        upto += r.v
        if upto > head_words:
            break
        least = r.n
    head = counts.where(f"kind = 0 AND n >= {least}").select("key", "n", "bucket").collect() if least else []
    cells = np.zeros((2, ENDINGS * AROUND))
    for r in counts.where("kind IN (1, 2)").collect():
        cells[r.kind - 1, r.key] = r.n
    around = np.concatenate([c.reshape(ENDINGS, AROUND) for c in cells], axis=1)
    of_class = 1 + clusters(around, CLASSES - 1)
    ending_cell = np.zeros(ENDINGS, np.int64)
    for c in range(1, CLASSES):
        own = of_class == c
        ending_cell[own] = c * CELLS + SINGLES + clusters(around * own[:, None], CELLS - SINGLES)[own]
    # a cell each: the most frequent words in class 0 after the end, then those of each class
    singles, used = [], np.zeros(CLASSES, np.int64)
    used[0] = 1
    for r in sorted(head, key=lambda r: (-r.n, r.key)):
        c = 0 if used[0] < CELLS else of_class[r.bucket]
        if used[c] < (CELLS if c == 0 else SINGLES):
            singles.append((r, c * CELLS + used[c]))
            used[c] += 1
    n_cell, v_cell = np.zeros((2, CLASSES * CELLS))
    for r in counts.where("kind = 0").groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_cell[ending_cell[r.bucket]] += r.n
        v_cell[ending_cell[r.bucket]] += r.v
    z = np.ones(CLASSES * CELLS)
    n_cell[END], z[END] = n_end, n_end + 1.0
    for r, c in singles:
        n_cell[ending_cell[r.bucket]] -= r.n
        v_cell[ending_cell[r.bucket]] -= 1
        n_cell[c], z[c] = r.n, r.n + 1.0
    rest = np.unique(ending_cell)
    z[rest] = n_cell[rest] + v_cell[rest] + 1
    as_hash = lambda rows: np.array([r.key for r in rows], np.int64).view(_U)
    model = Model(as_hash(head), np.array([r.n for r in head], float), as_hash([r for r, _ in singles]), np.array([c for _, c in singles], np.int64), ending_cell, np.log10(z), n_cell, n_words + n_end, n_distinct + bool(n_end), n_end)
    return model, counts.where("kind = 0").select("key", "n")


def _events(docs: DataFrame, held) -> DataFrame:
    """(shard, slice, doc, event) of docs (doc_id, text, learnt): a row a slice and shard with its events, in the
    order of documents, and the step from each event's document to the next; and, in a shard below 0, what is known of the slice's documents."""
    made: dict = {}

    def run(batches):
        from pyspark import TaskContext

        if "model" not in made:
            made["model"] = pickle.loads(held.value)
        m, split = made["model"], TaskContext.get().partitionId()
        for k, b in enumerate(slices(batches, 1, 2 << 20)):
            at = split << 24 | k
            w = words(b.column(1), lower=True)
            h, c, first = m.tokens(w)
            n = np.diff(first)
            doc = np.repeat(np.arange(b.num_rows), n)
            one, two, pair = m.contexts(h, c, first)
            learnt = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            events = pack(m.rows_of(one, two, pair), c, learnt[doc])
            shard = m.shard(one, two, mix(doc.astype(_U) + mix(np.array([at], _U))))
            order = np.argsort(shard.astype(np.uint16) if m.shards < 1 << 16 else shard, kind="stable")
            shard, events, doc_of = shard[order], events[order], doc[order]
            start = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            step = np.diff(doc_of, prepend=0)
            step[start] = doc_of[start]
            step = step.astype("<u2" if b.num_rows < 1 << 16 else "<u4")
            end = [*start[1:], len(shard)]
            yield _batch(shard[start], np.full(len(start), at), [_pressed(step[i:j]) for i, j in zip(start, end)], [_pressed(events[i:j]) for i, j in zip(start, end)])

            k = np.minimum(np.searchsorted(m.head, h), max(len(m.head) - 1, 0))
            known = (m.head[k] == h) & (h != 0) if len(m.head) else np.zeros(len(h), bool)
            log_c = np.where(known, m.head_log[k], 0.0) if len(m.head) else np.zeros(len(h))
            log_c[first[1:] - 1], known[first[1:] - 1] = math.log10(m.n_end + 1), m.n_end > 0
            tail = np.flatnonzero(~known & (h != 0))
            sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), log_c, -m.log_z[c])]
            about = (b.column(0).to_pylist(), n, *sums, np.bincount(doc[tail], minlength=b.num_rows), h[tail].view(np.int64))
            yield _batch([-1 - split], [at], [pickle.dumps(about)], [None])

    return docs.mapInArrow(run, "shard long, slice long, doc binary, event binary")


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "slice", "doc", "event"])


def _in_shards(events: DataFrame, held, rate: float) -> DataFrame:
    """(slice, doc, sums): the documents of each slice and shard, and the sum of their events' logarithms; rows of shards below 0 pass."""

    def run(t: pa.Table) -> pa.Table:
        out = lambda *x: pa.table([pa.array(c, k) for c, k in zip(x, (pa.int64(), pa.binary(), pa.binary()))], names=["slice", "doc", "sums"])
        if t.column("shard")[0].as_py() < 0:
            return t.select(["slice", "doc", "event"]).rename_columns(["slice", "doc", "sums"])
        t = t.sort_by("slice")
        m = pickle.loads(held.value)
        blobs = [_restored(x) for x in t.column("event").to_pylist()]
        events = np.concatenate(blobs)
        for a in range(0, len(events), _CHUNK):
            rows, c, learnt = unpack(events[a : a + _CHUNK])
            m.train(rows[:, learnt], c[learnt], rate)
        lp = np.empty(len(events), np.float32)
        for a in range(0, len(events), 16384):
            rows, c, _ = unpack(events[a : a + 16384])
            lp[a : a + 16384] = m.log_p(rows, c)
        docs, sums, at = [], [], 0
        for blob, step in zip(blobs, t.column("doc").to_pylist()):
            step = _restored(step)
            doc = np.cumsum(step, dtype=np.int64)
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            docs.append(_pressed(np.diff(doc[start], prepend=0).astype(step.dtype)))
            sums.append(np.add.reduceat(lp[at : at + len(blob)].astype(float), start).astype("<f4").tobytes())
            at += len(blob)
        return out(t.column("slice").to_numpy(), docs, sums)

    return events.groupBy("shard").applyInArrow(run, "slice long, doc binary, sums binary")


def _documents(parts: DataFrame) -> DataFrame:
    """A row a document from all that _in_shards has of its slice."""

    def run(t: pa.Table) -> pa.Table:
        docs, sums = t.column("doc").to_pylist(), t.column("sums").to_pylist()
        ids, n, known, log_head, part, n_tail, tail = pickle.loads(next(d for d, s in zip(docs, sums) if s is None))
        total = np.zeros(len(n))
        for d, s in sorted((d, s) for d, s in zip(docs, sums) if s is not None):
            total[np.cumsum(_restored(d), dtype=np.int64)] += np.frombuffer(s, "<f4")
        off = np.concatenate(([0], np.cumsum(n_tail))).astype(np.int32)
        cols = [pa.array(ids, pa.int64()), pa.array(n), pa.array(known), pa.array(log_head), pa.array(part + total / math.log(10)), pa.ListArray.from_arrays(pa.array(off), pa.array(tail))]
        return pa.table(cols, names=["doc_id", "n_tokens", "n_head", "log_head", "part", "tail"])

    return parts.groupBy("slice").applyInArrow(run, "doc_id long, n_tokens long, n_head long, log_head double, part double, tail array<long>")


def score_documents(spark: SparkSession, docs: DataFrame, rate: float = 2.0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    The model learns from rows that are not held out; a row with a null doc_id is neither
    learnt from nor held out. Null texts are empty: one token, the end. Repeated rows count as
    often as they are there; a text of any length goes token by token. With nothing to learn from every class has its prior share. An
    empty table gives no rows; other columns are not read.
    """
    with Scratch(spark) as scratch:
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        model, counts = train_model(scratch, src.where(~held_out_id(F.col("doc_id"))))
        held = spark.sparkContext.broadcast(pickle.dumps(model))
        learnt = F.coalesce(~held_out_id(F.col("doc_id")), F.lit(False)).alias("learnt")
        scored = _documents(_in_shards(_events(src.select("*", learnt), held), held, rate))
        scored = scratch.written(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
        rest = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")).join(counts, "key")
        rest = rest.groupBy("row").agg(F.sum("times").alias("n_rest"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_rest"))
        out = scored.drop("tail").join(rest, "row", "left")
        logs = F.col("log_head") + F.coalesce("log_rest", F.lit(0.0))
        out = out.select(
            "doc_id", F.coalesce(held_out_id(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
            F.lit(model.n).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * math.log10(model.n + model.v + 1)).alias("base_score"), (logs + F.col("part")).alias("score"),
        )
        out = scratch.keep(out, "scores")
        held.destroy()
        return out
