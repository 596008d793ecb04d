"""Near duplicates by circulant MinHash, with exact verification on full shingle sets.

A document's set is its distinct ``width``-word shingles (all its words as one shingle
where it has fewer). Two bijections of 32-bit integers, sigma and pi, make the whole
signature: coordinate k is the least pi(sigma(x) - k) over the set, that is, pi circularly
shifted by k. ``rows`` coordinates form a band; documents that share a band are candidates,
and a link holds if 100 * intersection >= percent * union on the full sets.

With the defaults, 32 bands of 5 rows, a pair at similarity 0.85 shares no band with
probability 7e-9 and one at 0.8 with 3e-6.

Documents with equal sets are one node from the start, so that a group of copies costs one
signature in the candidate search, however large it is. Candidates in a bucket of bands
are compared with the bucket's centre first; components are then contracted, and only
buckets that still hold several components go on: first with the other centres, then with a
random sample of 64 pivots. A pair goes from there to its full sets only if it lies in
different components, if bitmaps of its shingles leave room for the intersection it needs (an
exact bound), and if its whole signatures, of which the bucket rows carry four bits a
coordinate, differ no more than most_differences(), a bound that a pair at the threshold
exceeds with no greater chance than that of sharing no band; it is taken up in the first band
it shares. Members of buckets that are still mixed meet by prefixes of their sets, the
rarest shingles first: sets that are similar enough share one of them, early enough that what follows
reaches the intersection they need, so this step loses
nothing, and documents that share only what is frequent, as those of one template do, don't meet.
So a large group of near copies costs little more than its own links, no cap is set on buckets
or partners, and no pair is looked at for being in a bucket alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch
from ballast.llm._words import mix, shingles, slices, window_hash, words
from ballast.llm.components import labels, star_edges, stars

_U = np.uint64


def _pi(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers (xor-shifts and odd multipliers)."""
    np.right_shift(x, 16, out=out)
    np.bitwise_xor(out, x, out=out)
    np.multiply(out, np.uint32(0x7FEB352D), out=out)
    np.bitwise_xor(out, out >> np.uint32(15), out=out)
    np.multiply(out, np.uint32(0x846CA68B), out=out)
    np.bitwise_xor(out, out >> np.uint32(16), out=out)
    return out


def sigma(x: np.ndarray) -> np.ndarray:
    """Shingles as 32-bit integers in an order unlike pi's."""
    return (mix(x ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)


def signatures(x: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """C-MinHash of the sets that begin at ``starts`` in ``x`` (none is empty): an array of sets by coordinates."""
    s, y, out = sigma(x), np.empty(len(x), np.uint32), np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_pi(s - np.uint32(k + 1), y), starts)
    return out.T


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band, apart for equal values in different bands."""
    n = sig.shape[1] // rows
    key = np.broadcast_to(mix(np.arange(1, n + 1, dtype=_U)), (len(sig), n)).copy()
    for r in range(rows):
        key = mix((key ^ sig[:, r::rows][:, :n].astype(_U)) * _U(0x9FB21C651E98DF25) + _U(r + 1))
    return key


def nibbles(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each coordinate, 16 to a 64-bit integer."""
    n = -(-sig.shape[1] // 16)
    low = np.zeros((len(sig), n * 16), _U)
    low[:, : sig.shape[1]] = sig & np.uint32(15)
    return np.bitwise_or.reduce(low.reshape(len(sig), n, 16) << (_U(4) * np.arange(16, dtype=_U)), axis=2)


_BITS = 1024


def bitmaps(x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """_BITS bits a document, set where a shingle falls, as 64-bit integers."""
    flags = np.zeros(n * _BITS, bool)
    flags[doc * _BITS + (mix(x ^ _U(0x3C6EF372FE94F82B)) & _U(_BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags.reshape(n, _BITS), axis=1, bitorder="little").view(np.int64)


def _room(percent: int) -> str:
    """Whether the bitmaps allow the intersection that the sizes ask for, in SQL.

    A shared shingle has a shared bit, and at most spare = n - (bits set) shingles of a set fell
    on a bit that another of it had set.
    """
    shared = " + ".join(f"bit_count(a.m[{i}] & b.m[{i}])" for i in range(_BITS // 64))
    return f"({shared} + least(a.spare, b.spare)) * {100 + percent} >= {percent} * (a.n + b.n)"


def most_differences(bands: int, rows: int, percent: int) -> int:
    """Differing nibbles (of bands * rows) that a pair exactly at the threshold exceeds no more likely than it shares no band."""
    n, s = bands * rows, percent / 100
    miss, m = (1 - s**rows) ** bands, (1 - s) * 15 / 16
    tail, k = 0.0, n
    while k > 0 and tail + (p := math.comb(n, k) * m**k * (1 - m) ** (n - k)) <= miss:
        tail, k = tail + p, k - 1
    return k


def _differences(n: int) -> str:
    """Number of coordinates whose nibbles differ between two rows, in SQL."""
    def one(i: int) -> str:
        x = f"(a.q[{i}] ^ b.q[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        return f"bit_count(({y} | shiftrightunsigned({y}, 2)) & 1229782938247303441L)"

    return " + ".join(map(one, range(n)))


def document_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, ascending, one after the other, and their numbers."""
    w = words(column, lower=True)
    h, n = w.hashes(), w.counts
    x, at = shingles(h, w.first, width)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        parts = np.concatenate([window_hash(h, w.first[short[n[short] == k]], k) for k in range(1, width)])
        x = np.concatenate((x, parts))
        doc = np.concatenate((doc, *(short[n[short] == k] for k in range(1, width))))
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return x[keep], np.bincount(doc[keep], minlength=len(n))


def _features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    n_q = -(-bands * rows // 16)

    def run(batches):
        for b in slices(batches):
            x, n = document_sets(b.column(1), width)
            some = np.flatnonzero(n)
            h1, h2, keys, q = np.zeros(len(n), _U), np.zeros(len(n), _U), np.zeros((len(n), bands), _U), np.zeros((len(n), n_q), _U)
            m = bitmaps(x, np.repeat(np.arange(len(n)), n), len(n))
            if len(some):
                starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                h1[some], h2[some] = (np.add.reduceat(mix(x ^ _U(c)), starts) for c in (0x1234567, 0x89ABCDEF01))
                sig = signatures(x, starts, bands * rows)
                keys[some], q[some] = band_keys(sig, rows), nibbles(sig)
            lists = lambda x, k: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, k, 0)))).astype(np.int32)), pa.array(np.ascontiguousarray(x[some]).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists(keys, bands), lists(q, n_q), lists(m, _BITS // 64)],
                names=["doc_id", "n", "h1", "h2", "bands", "q", "m"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, q array<long>, m array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            x, n = document_sets(b.column(1), width)
            off = np.concatenate(([0], np.cumsum(n * 8))).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["node", "set"])

    return docs.mapInArrow(run, "node long, set binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for t in batches:
            a, b = (np.array([similar(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), percent) for x, y in zip(t.column(2), t.column(3))], bool), t)
            yield b.select([0, 1]).filter(pa.array(a))

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    # sets whose sizes alone rule the link out go no further
    both = both.where(F.least(F.length("sa"), F.length("sb")) * 100 >= F.greatest(F.length("sa"), F.length("sb")) * percent)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 32, rows: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) a row of ``docs``.

    component_id is the least doc_id that links lead to; kept says whether it is the row's
    own. Null and empty texts have no shingles and no links. Rows that share a doc_id are
    one document in the graph, linked to what any of their texts links to. A null doc_id is
    no document's name: such a row takes no part, has no component and is kept. A text of any
    length is one row's work, its shingles one array of hashes. An empty
    table gives no rows; other columns are not read.
    """
    with Scratch(spark) as scratch:
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        member, e = _linked(scratch, src, percent, width, bands, rows)
        # a component's name is the least rep in it, and a rep is the least doc_id of its set
        out = member.select("doc_id", "n", "rep").join(e.select(F.col("u").alias("rep"), F.col("v").alias("component")), "rep", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
        return scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.coalesce(component == F.col("doc_id"), F.lit(True))).alias("kept")), "components")


def _linked(scratch: Scratch, src: DataFrame, percent: int, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, rep, ...) of each row, rep being the least doc_id of its set; and the stars (u, v) of linked reps."""
    written, drop = scratch.written, scratch.drop
    features = written(_features(src, width, bands, rows), "features")
    named = features.where("n > 0 AND doc_id IS NOT NULL")
    # groups of copies alone; written, so that their join has an exchange on either side and a large group is split
    copies = written(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"), "copies")
    rep = F.coalesce("least", F.when(F.col("n") > 0, F.col("doc_id")))
    member = features.join(copies, ["h1", "h2", "n"], "left").select("doc_id", "n", rep.alias("rep"), "bands", "q", "m")
    member = written(member.select("doc_id", "n", "rep", *(F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("bands", "q", "m"))), "member")
    drop(features, copies)

    keyed = member.where("doc_id = rep").select(F.col("rep").alias("node"), F.explode("bands").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).where("centre <> other").select("key", "centre")
    buckets = written(keyed.join(centres, "key").distinct(), "buckets")
    in_buckets = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = written(_sets(src.join(in_buckets, "doc_id"), width), "sets")

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    # star tables: tried pairs and the stars of the links so far
    tried = [written(buckets.where("node <> centre").groupBy("node").agg(F.min("centre").alias("centre")).select(*pair("node", "centre")).distinct(), "tried")]
    e = stars(scratch, star_edges(_verify(tried[0], sets, percent)))
    bits = " + ".join(f"bit_count(m[{i}])" for i in range(_BITS // 64))
    in_bands = member.where("doc_id = rep").select(F.col("rep").alias("node"), "n", "bands", "q", "m", F.expr(f"n - ({bits})").alias("spare"))
    alike = f"{_room(percent)} AND {_differences(-(-bands * rows // 16))} <= {most_differences(bands, rows, percent)}"
    for pivots in (0, 64):
        now = buckets.join(labels(e), "node", "left").select("key", "node", "centre", F.coalesce("component", "node").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least <> most").select("key", "size")
        now = written(now.join(mixed, "key").join(in_bands, "node").withColumn("turn", F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("size") / float(1 << 30)), "mixed")
        if pivots == 0:
            chosen, once = now.where("node = centre"), "a.node <> a.centre"
        else:
            # two pivots meet once
            chosen, once = now.where(f"turn < {pivots}"), f"(a.node < b.node OR a.turn >= {pivots})"
        # equal keys, then in this order: different components, alike signatures, the first band that both have
        first_band = "a.key = array_min(array_intersect(a.bands, b.bands))"
        pairs = now.alias("a").join(chosen.alias("b"), F.expr(f"a.key = b.key AND {once} AND a.component <> b.component AND {alike} AND {first_band}"))
        pairs = pairs.select(*pair(F.col("a.node"), F.col("b.node"))).distinct()
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        drop(now)
        e = _joined(scratch, e, pairs, sets, percent)
        tried.append(pairs)
    now = buckets.join(labels(e), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    left = written(now.join(mixed, "key").select("node", "component").distinct(), "left")
    if not left.isEmpty():
        e = _joined(scratch, e, written(_prefix_pairs(left.join(sets, "node"), in_bands.drop("bands"), percent, alike), "pairs"), sets, percent)
    return member, e


def _joined(scratch: Scratch, e: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stars e with the links among pairs; what is linked already is a star, so few steps are left."""
    if pairs.isEmpty():
        return e
    more = scratch.written(_verify(pairs, sets, percent), "links")
    if more.isEmpty():
        return e
    out = stars(scratch, star_edges(more).unionByName(e).distinct())
    scratch.drop(e)
    return out


def _prefix_pairs(rows: DataFrame, traits: DataFrame, percent: int, alike: str) -> DataFrame:
    """(a, b): pairs of rows (node, component, set) in different components that may have the similarity asked for.

    traits: (node, n and what the test ``alike`` of two rows needs). A node may have several sets, each with its own row.

    Two such sets share a shingle among the first n - ceil(n * percent / 100) + 1 of either, in any one order
    of all shingles; here those that fewest rows have come first. Where they share their first one, at positions i and j, neither has more
    left than n - i and n - j, so these must reach the intersection that the sizes ask for; the smaller set's prefix is shorter by that.
    """

    def run(batches):
        for b in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(3)]
            n = np.array([len(x) for x in found])
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(np.concatenate(found))], names=["node", "component", "of", "shingle"])

    said = rows.select("node", "component", F.xxhash64("set").alias("of"), "set").mapInArrow(run, "node long, component long, of long, shingle long")
    often = said.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    whole = said.join(often, "shingle", "left").groupBy("node", "component", "of").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("rows", F.lit(1)).alias("rows"), "shingle"))).alias("s"))
    whole = whole.withColumn("n", F.size("s").cast("long")).join(traits, ["node", "n"])
    prefix = whole.select("component", *traits.columns, F.posexplode(F.expr(f"slice(s, 1, int(n - ceil(n * {percent} / 100) + 1))")).alias("at", "s")).where("s.rows > 1").select("component", *traits.columns, "at", "s.shingle")
    need = f"(n - at) * {100 + percent} >= {2 * percent} * n"
    a, b = prefix.where(need).alias("a"), prefix.alias("b")
    meet = f"a.component <> b.component AND (a.n < b.n OR (a.n = b.n AND a.node < b.node)) AND a.n * 100 >= b.n * {percent}"
    reach = f"least(a.n - a.at, b.n - b.at) * {100 + percent} >= {percent} * (a.n + b.n)"
    pairs = a.join(b, F.expr(f"a.shingle = b.shingle AND {meet} AND {reach} AND {alike}"))
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
