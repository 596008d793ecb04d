"""Token-id shards with Elias-Fano document boundaries.

One shard file, little-endian:

    ids        n_ids unsigned 16-bit (32-bit where the vocabulary needs it) integers, one document after the other
    footer     two Elias-Fano sequences: the end of each document, in ids from the shard's start,
               and the doc_ids (less the smallest), which ascend
    trailer    10 unsigned 64-bit integers: n_ids, n_docs, n_null (documents without a doc_id, first),
               smallest doc_id (two's complement), id width in bytes, low bits and high words of either sequence, magic

An Elias-Fano sequence of n values up to u keeps the floor(log2(u/n)) low bits of each value packed,
and the high bits in unary in a bit vector of at most 2n + 1 bits: under 2 + log2(u/n) bits a
value, against 64 in a table. select(k) finds the k-th set bit by a directory of one
counter each 512 bits and a search in the word.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.llm._encode import encoder
from ballast.llm._shared import create_file, new_path, open_file, written

MAGIC = 0x31464531_4B4F5442
_TRAILER = 10
_STEP = 8  # 64-bit words a directory entry


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.bitwise_count(high).astype(np.int64)
        self.directory = np.concatenate(([0], np.cumsum(np.add.reduceat(counts, np.arange(0, len(high), _STEP))))) if len(high) else np.zeros(1, np.int64)

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = _pack(ones, None, int(ones[-1]) + 1)
        at = np.arange(n, dtype=np.int64) * low_bits
        low = _pack(at, (v & np.uint64((1 << low_bits) - 1), low_bits), n * low_bits) if low_bits else np.zeros(0, np.uint64)
        return cls(n, low_bits, low, high)

    def _word(self, k: int) -> tuple[int, int]:
        """The word that holds the k-th set bit, and the set bits before it: the directory, then at most _STEP words."""
        block = int(np.searchsorted(self.directory, k, side="right")) - 1
        left, word = k - int(self.directory[block]), block * _STEP
        while (c := int(self.high[word]).bit_count()) <= left:
            left, word = left - c, word + 1
        return word, k - left

    def select(self, k: int) -> int:
        """The k-th value."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        word, before = self._word(k)
        bits = int(self.high[word])
        for _ in range(k - before):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - k
        return high << self.low_bits | int(self._low(np.array([k]))[0])

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(k), np.uint64)
        word, bit = np.divmod(k * self.low_bits, 64)
        bit = bit.astype(np.uint64)
        x = self.low[word] >> bit
        cross = bit + np.uint64(self.low_bits) > 64
        x[cross] |= self.low[word[cross] + 1] << (np.uint64(64) - bit[cross])
        return x & np.uint64((1 << self.low_bits) - 1)

    def some(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: the words between the two ends that select finds."""
        if b <= a:
            return np.zeros(0, np.uint64)
        word, before = self._word(a)
        bits = np.unpackbits(self.high[word : self._word(b - 1)[0] + 1].view(np.uint8), bitorder="little")
        k = np.arange(a, b)
        ones = np.flatnonzero(bits)[a - before : b - before] + 64 * word
        return (ones - k).astype(np.uint64) << np.uint64(self.low_bits) | self._low(k)

    def tobytes(self) -> bytes:
        return self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @property
    def bits(self) -> int:
        return 64 * (len(self.low) + len(self.high))

    @classmethod
    def frombytes(cls, n: int, low_bits: int, n_high: int, data: bytes) -> EliasFano:
        words = np.frombuffer(data, "<u8")
        return cls(n, low_bits, words[: len(words) - n_high], words[len(words) - n_high :])

    @staticmethod
    def size(n: int, low_bits: int, n_high: int) -> int:
        return 8 * ((n * low_bits + 63) // 64 + n_high)


def _pack(at: np.ndarray, fields, n_bits: int) -> np.ndarray:
    """64-bit words with single bits, or (values, width), set at ``at``."""
    out = np.zeros((n_bits + 63) // 64, np.uint64)
    word, bit = np.divmod(at, 64)
    bit = bit.astype(np.uint64)
    if fields is None:
        np.bitwise_or.at(out, word, np.uint64(1) << bit)
        return out
    values, width = fields
    np.bitwise_or.at(out, word, values << bit)
    cross = bit + np.uint64(width) > 64
    np.bitwise_or.at(out, word[cross] + 1, values[cross] >> (np.uint64(64) - bit[cross]))
    return out


class ShardReader:
    """Random access to one shard: ``len``, ``offset(k)`` by select, ``ids(k)``, ``doc_id(k)``."""

    def __init__(self, uri: str):
        self.f = open_file(uri)
        self.f.seek(0, 2)
        size = self.f.tell()
        self.f.seek(size - 8 * _TRAILER)
        t = np.frombuffer(self.f.read(8 * _TRAILER), "<u8")
        if int(t[9]) != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.n_ids, self.n_docs, self.n_null, self.width = int(t[0]), int(t[1]), int(t[2]), int(t[4])
        self.least = int(t[3].astype(np.int64))
        ends, docs = (self.n_docs, int(t[5]), int(t[6])), (self.n_docs - self.n_null, int(t[7]), int(t[8]))
        self.f.seek(size - 8 * _TRAILER - EliasFano.size(*ends) - EliasFano.size(*docs))
        self.ends = EliasFano.frombytes(*ends, self.f.read(EliasFano.size(*ends)))
        self.docs = EliasFano.frombytes(*docs, self.f.read(EliasFano.size(*docs)))

    def __len__(self) -> int:
        return self.n_docs

    def offset(self, k: int) -> int:
        return self.ends.select(k - 1) if k else 0

    def doc_id(self, k: int) -> int | None:
        return None if k < self.n_null else self.least + self.docs.select(k - self.n_null)

    def ids(self, k: int) -> np.ndarray:
        start, end = self.offset(k), self.ends.select(k)
        self.f.seek(start * self.width)
        return np.frombuffer(self.f.read((end - start) * self.width), f"<u{self.width}").astype("<u4")

    def scan(self, docs: int = 4096, some: int = 1 << 20):
        """Lists of (doc_id, start, ids), of ``docs`` documents whose offsets select gives, read in pieces of about ``some`` ids."""
        for a in range(0, self.n_docs, docs):
            b = min(a + docs, self.n_docs)
            ends = np.concatenate(([self.offset(a)], self.ends.some(a, b).astype(np.int64)))
            nulls = max(min(b, self.n_null) - a, 0)
            names = [None] * nulls + (self.docs.some(max(a - self.n_null, 0), b - self.n_null).astype(np.int64) + self.least).tolist()
            k, out = 0, []
            while k < b - a:
                stop = max(k + 1, int(np.searchsorted(ends, ends[k] + some, side="right")) - 1)
                self.f.seek(int(ends[k]) * self.width)
                ids = np.frombuffer(self.f.read(int(ends[stop] - ends[k]) * self.width), f"<u{self.width}").astype("<u4")
                out += [(names[i], int(ends[i]), ids[ends[i] - ends[k] : ends[i + 1] - ends[k]]) for i in range(k, stop)]
                k = stop
                if sum(len(x[2]) for x in out) >= some:
                    yield out
                    out = []
            if out:
                yield out

    def close(self) -> None:
        self.f.close()


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = 64 << 20, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes ``docs`` in ascending doc_id order; returns the manifest, a table of a row a shard.

    Shards hold about ``shard_bytes`` of text (less where that would leave tasks idle), so what a
    task keeps, eight bytes a boundary, is bounded. Null texts are empty (the end id alone), null
    doc_ids come first, equal doc_ids stand in the order of a hash of their texts, by which shards
    also part them. A text of any length is one row's work. An empty table gives an empty manifest. Other columns are not read. A shard is
    written under a name of its own attempt and only the attempt that succeeded is in the manifest,
    so a task that runs again leaves nothing wrong behind.
    """
    path = path or new_path(spark, "token-shards")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not shards:
        size = src.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
        shards = max(1, -(-size // shard_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (1 << 20))))

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if len(enc.is_end) <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        ends, names, total, nulls = array("q"), array("q"), 0, 0
        uri = f"{path}/shard-{part:06d}-{TaskContext.get().taskAttemptId()}.ids"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with create_file(uri) as f:
            for b in (x for xs in ([first], batches) for x in xs):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(enc.ids(text.as_py()) + end, "<u4")
                    f.write(x.astype(f"<u{width}").tobytes())
                    total += len(x)
                    ends.append(total)
                    if doc_id is None:
                        nulls += 1
                    else:
                        names.append(doc_id)
            least = names[0] if names else 0
            e, d = EliasFano.encode(np.array(ends, np.int64)), EliasFano.encode(np.array(names, np.int64) - least)
            f.write(e.tobytes() + d.tobytes())
            f.write(np.array([total, len(ends), nulls, least & (1 << 64) - 1, width, e.low_bits, len(e.high), d.low_bits, len(d.high), MAGIC], "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "uri": [uri], "n_docs": pa.array([len(ends)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "boundary_bits": pa.array([e.bits], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = src.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return written(spark, ordered.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long, boundary_bits long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""

    def run(batches):
        names, kinds = ("doc_id", "start", "n_tokens", "ids_crc32", "shard"), [pa.int64()] * 4 + [pa.int32()]
        for b in batches:
            for shard, uri, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                r = ShardReader(uri)
                for found in r.scan():
                    rows = [(doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()), shard) for doc_id, start, ids in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                r.close()

    # a row a shard: the running total over the manifest is small at any size of the corpus
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    rows = manifest.select("shard", "uri", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return rows.repartition(int(n), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
