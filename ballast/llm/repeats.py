"""Removal of passages that an earlier document already has, by repeated-phrase automata.

A window is ``window`` consecutive words. A window's phrase is its least-hashed run of
``phrase`` words (a minimiser), so equal windows have equal phrases at equal places.

1. One scan writes each document's phrases as text. Grouped by that text, those of two or
   more word sequences are confirmed as recurring.
2. Recurring phrases are dealt to shards by the least document that has them, so that the
   phrases of a passage share a shard, in about ``shard_bytes`` of text each, a file a shard.
3. A document goes to the shards of its recurring phrases; documents without any cannot hold
   a repeated window. A task compiles a shard's phrases into an Aho-Corasick automaton and
   streams the shard's documents through it. What the automaton finds, and nothing else, gives
   the windows to confirm: those whose phrase stands at an occurrence.
4. Windows are confirmed across documents by 96-bit hashes: the least doc_id of each is an
   aggregate, and a window of a greater doc_id is a repeat.
5. The words that repeats cover go.

Documents whose whole word sequence an earlier one has are told by two 64-bit hashes and
their length in step 1, and go whole: a group of copies costs one document's windows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch, create_file, fresh, open_file
from ballast.llm._words import Words, mix, slices, window_hash, words

_U = np.uint64
_WORD = re.compile("[^\x20\x09-\x0d]+")
_EMPTY = hashlib.sha256(b"").hexdigest()
_MOST = _U(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each ``k`` consecutive values, by doubling."""
    m, size = x, 1
    while 2 * size <= k:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    return np.minimum(m[: len(x) - k + 1], m[k - size :]) if len(x) >= k else x[:0]


def run_hashes(w: Words, h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of the run of ``phrase`` words from each word; and of each window its document, its first word and its least run."""
    if len(h) < window:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    x = window_hash(h, np.arange(len(h) - phrase + 1), phrase)
    n = np.maximum(w.counts - window + 1, 0)
    at = np.arange(int(n.sum())) + np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return x, np.repeat(np.arange(len(n)), n), at, sliding_min(x, window - phrase + 1)[at]


def phrases(w: Words, h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and hash of each distinct phrase of each document."""
    x, doc, at, least = run_hashes(w, h, window, phrase)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    doc, at, least = doc[new], at[new], least[new]
    order = np.lexsort((at, least, doc))
    doc, at, least = doc[order], at[order], least[order]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    doc, at, least = doc[new], at[new], least[new]
    if len(at):  # from the window to the place of its phrase
        span = np.minimum(at[:, None] + np.arange(window - phrase + 1), len(x) - 1)
        at = at + (x[span] == least[:, None]).argmax(axis=1)
    return doc, at, least


def sequence_hashes(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole word sequence; 0 where there is none."""
    n, out = w.counts, []
    for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
        x = np.zeros(len(n), _U)
        some = np.flatnonzero(n)
        at = np.arange(len(h)) - np.repeat(w.first[:-1], n)
        if len(some):
            x[some] = mix(np.add.reduceat(mix(h ^ mix(at.astype(_U) + _U(salt))), w.first[some]))
        out.append(x)
    return tuple(out)


def _joined_sha(found: list[str]) -> str:
    return hashlib.sha256(" ".join(found).encode("utf-8", "surrogatepass")).hexdigest()


def _text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(text)


def _scan(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """docs: doc_id, text, seq. phrases: hashes of a document's distinct phrases; said: their texts."""

    def run(batches):
        for b in slices(batches):
            w = words(b.column(1))
            h = w.hashes()
            doc, at, least = phrases(w, h, window, phrase)
            s1, s2 = sequence_hashes(w, h)
            off = np.searchsorted(doc, np.arange(b.num_rows + 1))
            sha, said = [], []
            for d, t in enumerate(b.column(1).to_pylist()):
                found = _WORD.findall(t) if t else []
                sha.append(_joined_sha(found) if found else _EMPTY)
                said += [" ".join(found[i : i + phrase]) for i in (at[off[d] : off[d + 1]] - w.first[d]).tolist()]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(w.counts.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sha), lists(pa.array(least.view(np.int64))), lists(pa.array(said, pa.string()))],
                names=["doc_id", "seq", "n_words", "s1", "s2", "sha", "phrases", "said"],
            )

    return docs.mapInArrow(run, "doc_id long, seq long, n_words long, s1 long, s2 long, sha string, phrases array<long>, said array<string>")


def automaton(texts):
    """Aho-Corasick over phrases; occurrences() asks it for whole words by a space on either side."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for t in texts:
        a.add_word(f" {t} ")
    a.make_automaton()
    return a


def occurrences(a, found: list[str], phrase: int) -> np.ndarray:
    """Words at which phrases of the automaton begin in a document given by its words."""
    if not len(a):
        return np.zeros(0, np.int64)
    space = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)))
    ends = np.fromiter((e for e, _ in a.iter(f" {' '.join(found)} ")), np.int64)
    return np.searchsorted(space, ends) - phrase


def _write_shards(recurring: DataFrame, path: str) -> DataFrame:
    """recurring: shard, said, a shard's rows together. A file a shard, of a phrase a line; and (shard, bytes)."""

    def run(batches):
        shard, held = None, []

        def out():
            data = "\n".join(held).encode("utf-8", "surrogatepass")
            with create_file(f"{path}/{shard}") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != shard and held:
                    yield out()
                    held = []
                shard = s
                held.append(t)
        if held:
            yield out()

    return recurring.mapInArrow(run, "shard long, bytes long")


def _windows(docs: DataFrame, path: str, window: int, phrase: int) -> DataFrame:
    """docs: shard, doc_id, seq, text, a shard's rows together. A row a document with windows to confirm."""

    def run(batches):
        shard, a = None, None
        for b in slices(batches, 3):
            w = words(b.column(3))
            h = w.hashes()
            x, doc, start, least = run_hashes(w, h, window, phrase)
            off = np.searchsorted(doc, np.arange(b.num_rows + 1))
            second, rows = mix(h ^ _U(0x6A09E667F3BCC909)), []
            for d, (s, doc_id, seq, text) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if s != shard:
                    a = None  # its memory first, it is some hundred times its text
                    with open_file(f"{path}/{s}") as f:
                        a, shard = automaton(f.read().decode("utf-8", "surrogatepass").split("\n")), s
                at = occurrences(a, _WORD.findall(text), phrase)
                lo, hi = off[d], off[d + 1]
                if not len(at) or lo == hi:
                    continue
                # hashes at occurrences alone; a window counts if its phrase is among them
                first, n = int(w.first[d]), int(w.counts[d]) - phrase + 1
                located = np.full(n, _MOST)
                located[at] = x[first + at]
                mine = np.flatnonzero(sliding_min(located, window - phrase + 1) == least[lo:hi])
                if len(mine):
                    key = window_hash(h, first + mine, window).view(np.int64)
                    check = (window_hash(second, first + mine, window) >> _U(32)).astype(np.uint32).view(np.int32)
                    rows.append((doc_id, seq, key, check, mine.astype(np.int32)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "seq", "key", "check", "at"])

    return docs.mapInArrow(run, "doc_id long, seq long, key array<long>, check array<int>, at array<int>")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """docs: doc_id, seq, text, starts (of windows that go)."""

    def run(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column(2).to_pylist(), b.column(3)):
                found = _WORD.findall(text)
                gone = np.zeros(len(found) + 1, np.int64)
                s = starts.values.to_numpy()
                np.add.at(gone, s, 1)
                np.add.at(gone, s + window, -1)
                kept = [x for x, g in zip(found, np.cumsum(gone)) if not g]
                out.append((len(found) - len(kept), _joined_sha(kept), " ".join(kept)))
            n, sha, text = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["doc_id", "seq", "cut", "cut_sha", "kept_text"])

    return docs.mapInArrow(run, "doc_id long, seq long, cut long, cut_sha string, kept_text string")


def find_repeats(scratch: Scratch, docs: DataFrame, window: int = 50, phrase: int = 8, shard_bytes: int = 1 << 18, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, seq, n_words, n_removed or null, sha) a row of ``docs``, n_removed and
    sha being those of rows that step 1 settles, and (doc_id, seq, cut, cut_sha, kept_text) of
    rows that lose some words. seq, a hash of the text, tells texts of equal doc_id apart.

    Null and empty texts have no words. "Earlier" is a smaller doc_id, so rows of equal doc_id
    remove nothing from one another; a row with a null doc_id is neither cut nor a reason to
    cut. A text of any length is one row's work. An empty table gives empty tables; other columns are not read.
    """
    spark = scratch.spark
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("seq"))
    scan = scratch.written(_scan(src, window, phrase), "phrases")
    long = scan.where(f"n_words >= {window} AND doc_id IS NOT NULL")
    # groups of copies alone; written, so that their join has an exchange on either side and a large group is split
    copies = scratch.written(long.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    copy = F.coalesce(F.col("doc_id") > F.col("earliest"), F.lit(False))
    settled = scratch.written(scan.drop("phrases", "said").join(copies, ["s1", "s2", "n_words"], "left").select("doc_id", "seq", "n_words", F.when(copy, F.col("n_words")).alias("n_removed"), F.when(copy, F.lit(_EMPTY)).otherwise(F.col("sha")).alias("sha")), "settled")

    said = long.select("doc_id", "s1", "s2", F.explode(F.arrays_zip("phrases", "said")).alias("p")).select("doc_id", "s1", "s2", F.col("p.phrases").alias("phrase"), F.col("p.said").alias("said"))
    both = said.groupBy("phrase", "said").agg(F.min("doc_id").alias("least"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)))
    recurring = scratch.written(both.where("min_s1 <> max_s1 OR min_s2 <> max_s2").select("phrase", "said", "least"), "recurring")
    size = recurring.agg(F.coalesce(F.sum(F.octet_length("said")), F.lit(0))).first()[0]
    shards = max(-(-size // shard_bytes), min(tasks, -(-size // (shard_bytes // 4))), 1)
    shard = F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard")
    files = scratch.path("phrase-shards")
    _write_shards(recurring.select(shard, "said").repartition(tasks, "shard").sortWithinPartitions("shard", "said"), files).write.format("noop").mode("overwrite").save()

    own = long.select("doc_id", "seq", F.explode("phrases").alias("phrase"))
    by_doc = own.join(recurring.select("phrase", shard), "phrase").groupBy("doc_id", "seq").agg(F.collect_set("shard").alias("shards"))
    open_ = settled.where("n_removed IS NULL").select("doc_id", "seq").distinct()
    routed = by_doc.join(open_, ["doc_id", "seq"])
    held = scratch.written(src.dropDuplicates(["doc_id", "seq"]).join(routed, ["doc_id", "seq"]).select("doc_id", "seq", "text", "shards"), "held")
    scratch.drop(scan, copies, recurring)
    # by ranges, so that a shard that many documents have is several tasks, each with its own automaton
    dealt = held.select(F.explode("shards").alias("shard"), "doc_id", "seq", "text").repartitionByRange(tasks, "shard", "doc_id", "seq").sortWithinPartitions("shard")
    near = scratch.written(_windows(dealt, files, window, phrase), "windows")

    windows = near.select("doc_id", "seq", F.explode(F.arrays_zip("key", "check", "at")).alias("w")).select("doc_id", "seq", F.col("w.key").alias("key"), F.col("w.check").alias("check"), F.col("w.at").alias("at"))
    # combined map-side, and written, so that the join below has an exchange on either side and a frequent window is split
    least = scratch.written(windows.groupBy("key", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("key", "check", "least"), "least")
    starts = windows.join(least, ["key", "check"]).where("doc_id > least").groupBy("doc_id", "seq").agg(F.collect_set("at").alias("starts"))
    cut = _cut(held.join(starts, ["doc_id", "seq"]).select("doc_id", "seq", "text", "starts"), window)
    return settled, scratch.written(cut, "cut")


def removal_report(spark: SparkSession, docs: DataFrame, window: int = 50, phrase: int = 8, **columns) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) a row of ``docs``; kept words are joined by one space."""
    with Scratch(spark) as scratch:
        settled, cut = find_repeats(scratch, docs, window, phrase, **columns)
        out = settled.join(cut.drop("kept_text"), ["doc_id", "seq"], "left")
        out = out.select("doc_id", "n_words", F.coalesce("n_removed", "cut", F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("n_removed").isNull(), F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))
        return scratch.keep(out, "removals")


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50, phrase: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut from its texts; documents with nothing left go.

    A document that loses nothing keeps its text as it is; of others the kept words stay,
    joined by one space. Rows without words that had none from the start stay as they are, and
    each of several texts of one doc_id has its own remainder. Extra columns of any name pass through.
    """
    with Scratch(spark) as scratch:
        settled, cut = find_repeats(scratch, docs, window, phrase, text_col=text_col, id_col=id_col)
        gone = settled.where("n_removed = n_words AND n_words > 0").select("doc_id", "seq", F.lit("").alias("kept_text")).distinct()
        i, q, k = (fresh(docs, f"_repeat_{x}") for x in ("doc", "seq", "kept"))
        change = gone.unionByName(cut.select("doc_id", "seq", "kept_text")).toDF(i, q, k)
        text = F.col(text_col).cast("string")
        out = docs.join(change, (F.col(id_col).cast("long") == F.col(i)) & (_text_key(text) == F.col(q)), "left").where(F.col(k).isNull() | (F.col(k) != ""))
        return scratch.keep(out.select(*(F.coalesce(F.col(k), text).alias(c) if c == text_col else F.col(c) for c in docs.columns)), "without-repeats")
