"""Token counts by section, from one encoding of each whole text.

A text is encoded once, as a whole, by a byte-level vocabulary, so tokens may cross section
borders. Tokens are intervals of bytes; sections are too. The two sorted lists of intervals
are joined by searching borders among token ends, and a token that crosses borders goes

    first      to the section of its first byte
    last       to the section of its last byte
    most       to the section with most of its bytes, the first of equals
    split      to every section it touches, by its share of bytes

Under each rule the sections' tokens sum up to the text's.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm._words import slices

RULES = ("first", "last", "most", "split")


class ByteEncoder:
    """Byte-level encoding of whole texts; a token's width is its number of bytes."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(x) for x in ranks]

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token. A lone surrogate counts as the three bytes of its replacement."""
        return np.cumsum(self.width[self.encoding.encode_ordinary(text)])


def allocate(ends: np.ndarray, borders: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section i is the bytes from borders[i] to borders[i + 1]."""
    n = len(borders) - 1
    if not len(ends):
        return np.zeros(n)
    starts = np.concatenate(([0], ends[:-1]))
    of = lambda at: np.searchsorted(borders, at, side="right") - 1
    a, b = of(starts), of(ends - 1)
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    out = np.bincount(a[a == b], minlength=n).astype(float)
    for i in np.flatnonzero(a != b):
        k = np.arange(a[i], b[i] + 1)
        share = np.minimum(borders[k + 1], ends[i]) - np.maximum(borders[k], starts[i])
        if rule == "most":
            out[k[np.argmax(share)]] += 1
        else:
            out[k] += share / (ends[i] - starts[i])
    return out


_ENCODERS: dict = {}


def section_token_counts(docs: DataFrame, path: str, pattern: str, rule: str = "first", text_col: str = "text", id_col: str = "doc_id", fields: list[str] | None = None) -> DataFrame:
    """(doc_id, section, start, length, n_tokens, doc_tokens, crossing): a row a section.

    Sections are the text's lines, each with the line feed that ends it, numbered from 0;
    start and length are in code points, crossing says how many tokens begin before the
    section and end in or after it. With ``fields`` they are these columns instead, laid end
    to end by name order as given (null: empty) and encoded as one text. A null or empty
    text is one empty section with no tokens. Null and repeated doc_ids are rows like any
    others, and a text of any length is encoded at once; an empty table gives no rows; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def borders_of(text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        cuts = np.flatnonzero(data == 10) + 1
        return np.unique(np.concatenate(([0], cuts, [len(data)]))) if len(data) else np.zeros(2, np.int64)

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteEncoder(path, pattern)
        enc = _ENCODERS[path]
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            parts = [b.column(1 + k).to_pylist() for k in range(b.num_columns - 1)]
            for d, doc_id in enumerate(b.column(0).to_pylist()):
                own = [p[d] or "" for p in parts]
                text = "".join(own)
                data = text.encode("utf-8", "replace")
                ends = enc.ends(text)
                if fields:
                    borders = np.concatenate(([0], np.cumsum([len(x.encode("utf-8", "replace")) for x in own])))
                else:
                    borders = borders_of(text)
                if len(ends) and ends[-1] != borders[-1]:
                    raise AssertionError("tokens do not cover the text")
                n = len(borders) - 1
                # bytes that begin a code point, before each border
                heads = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))[borders]
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                cross = np.searchsorted(starts, borders[:-1]) - np.searchsorted(ends, borders[:-1], side="right")
                for c, x in zip(cols, ([doc_id] * n, range(n), heads[:-1].tolist(), np.diff(heads).tolist(), allocate(ends, borders, rule).tolist(), [len(ends)] * n, cross.tolist())):
                    c.extend(x)
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "section", "start", "length", "n_tokens", "doc_tokens", "crossing"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields or [text_col])))
    return src.mapInArrow(run, "doc_id long, section long, start long, length long, n_tokens double, doc_tokens long, crossing long")
