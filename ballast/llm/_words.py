"""Words of whole Arrow text columns as numpy arrays: boundaries, 64-bit hashes, shingle hashes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Nothing is done a row or
a word at a time: a batch's UTF-8 buffer is scanned once, and a word's hash is a
difference of running sums, so the cost is a few operations a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the finaliser of a public hash)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_P = 0x9E6C63D0876A9A47  # odd, so that it has an inverse modulo 2**64
_Q = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = -(-n >> 18) << 18 if n > 1 << 18 else 1 << 18
            self.up, self.down = (np.cumprod(np.concatenate(([_U(1)], np.full(n - 1, b, _U))), dtype=_U) for b in (self.base, self.inverse))
        return self.up, self.down


_PP, _QP = _Powers(_P), _Powers(_Q)


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, one after the other
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: one after its last
    first: np.ndarray  #: first word of each document, and the number of words
    text: np.ndarray  #: first byte of each document, and the number of bytes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _PP(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, _U)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        h = total[self.end] - total[self.start]
        h *= down[self.start]
        h += (self.end - self.start).astype(_U) * _U(0xA0761D6478BD642F)
        return mix(h)

    def heads(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words that have as many, and those words."""
        at = np.flatnonzero(self.end - self.start >= n)
        up, down = _PP(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, _U)
        total[0] = 0
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        s = self.start[at]
        h = total[s + n] - total[s]
        h *= down[s]
        return mix(h + _U(n)), at

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a document, and the word at which each starts."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    at = np.arange(int(n.sum())) + np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return window_hash(h, at, k), at


def window_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each of ``at``; equal for equal words wherever they stand."""
    up, down = _QP(len(h) + 1)
    total = np.empty(len(h) + 1, _U)
    total[0] = 0
    np.cumsum(h * up[: len(h)], out=total[1:])
    x = total[at + k] - total[at]
    x *= down[at]
    return mix(x + _U(k))


def words(column: pa.Array, lower: bool = False, breaks: np.ndarray = _IS_SPACE) -> Words:
    """The words of a string column; nulls have none. lower: A-Z are lower-cased first. breaks: the bytes that are in no word."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    here = inside[1:-1]
    begins, ends = here & ~inside[:-2], here & ~inside[2:]
    edge = off[(off > 0) & (off < len(data))]
    begins[edge] = here[edge]
    ends[edge - 1] = here[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, off), off)


def slices(batches, column: int = 1, some: int = 1 << 20):
    """The batches cut into runs of rows with about ``some`` bytes of text, one row at least."""
    for b in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < b.num_rows:
            upto = (total[at - 1] if at else 0) + some
            stop = max(at + 1, int(np.searchsorted(total, upto, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def crc_of_id(ids: np.ndarray) -> list[int]:
    """crc32 of each doc_id written in decimal, as Spark's crc32(cast(doc_id as string))."""
    import zlib

    return [zlib.crc32(str(i).encode()) for i in ids]
