"""URL rules by sorted digest arrays: 64-bit keys that are mapped, searched by bisection and confirmed by text.

An array holds strings by their 64-bit xxhash: the keys in ascending order as unsigned 64-bit integers, the
strings one after the other with their offsets, and a payload for each. A probe hashes a batch of strings, finds all of them
among the mapped keys by one vectorised binary search, and compares the stored string with the probed one for every equal
key, so strings whose digests collide are told apart. Arrays are written in shards of a key range each, by as
many tasks, as one file each; a task maps the shards that its probes fall into. Nothing
is loaded whole: the pages of an array that are in use are shared by all workers of a machine.

A rule (host, path) fits the urls of its host and all subdomains whose path starts with its path.
One array has the hosts of the rules, with the lengths of the paths they have there; a second has
host and path together. A url probes its host's suffixes in the first and, for those that are there, its path's prefixes of those
lengths in the second: two searches a batch, whatever the number of rules.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch, _local, create_file, delete, new_path, open_file

SEED = 42
_MAGIC = b"BDIGEST1"
_HEAD = struct.Struct("<8sQQQ")  # magic, keys, bytes of strings, bytes of payloads
#: Parts of host names that mark a host for the list made from the pages.
BAD_PARTS = ("adult", "ads", "bets", "betting", "casino", "gambling", "pills", "poker", "porn", "spam", "viagra", "xxx")


def digests(strings: list[bytes], mask: int = (1 << 64) - 1) -> np.ndarray:
    """mask: bits that count, fewer of them only in tests of collisions."""
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) & mask for s in strings), np.uint64, len(strings))


def write_array(uri: str, strings: list[bytes], payloads: list[bytes], mask: int = (1 << 64) - 1) -> tuple[int, int]:
    """One shard from distinct strings; returns its least and greatest key."""
    keys = digests(strings, mask)
    order = np.argsort(keys, kind="stable")
    ends = lambda xs: np.concatenate(([0], np.cumsum([len(xs[i]) for i in order]))).astype("<u8")
    s, p = ends(strings), ends(payloads)
    with create_file(uri) as f:
        f.write(_HEAD.pack(_MAGIC, len(keys), int(s[-1]), int(p[-1])))
        for x in (keys[order].astype("<u8"), s, p):
            f.write(x.tobytes())
        for xs in (strings, payloads):
            f.write(b"".join(xs[i] for i in order))
    return int(keys[order[0]]), int(keys[order[-1]])


class DigestArray:
    """One shard, mapped where its folder is mounted; read into memory, a shard at a time, from stores that only Hadoop reaches."""

    def __init__(self, uri: str):
        if path := _local(uri):
            data = np.memmap(path, np.uint8, "r")
        else:
            with open_file(uri) as f:
                data = np.frombuffer(f.read(), np.uint8)
        magic, n, s, p = _HEAD.unpack(data[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no digest array")
        at = np.cumsum([_HEAD.size, 8 * n, 8 * (n + 1), 8 * (n + 1), s, p])
        self.keys, self.ends, self.payload_ends = (data[a:b].view("<u8") for a, b in zip(at[:3], at[1:4]))
        self.strings, self.payloads = data[at[3] : at[4]], data[at[4] : at[5]]

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def payload(self, i: int) -> bytes:
        return self.payloads[int(self.payload_ends[i]) : int(self.payload_ends[i + 1])].tobytes()

    def find(self, strings: list[bytes], keys: np.ndarray) -> list[bytes | None]:
        """The payload of each string, None where it isn't there."""
        out: list[bytes | None] = [None] * len(strings)
        at, upto = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        for k in np.flatnonzero(at < upto):
            # equal keys are next to each other
            out[k] = next((self.payload(i) for i in range(at[k], upto[k]) if self.string(i) == strings[k]), None)
        return out


@dataclass
class Index:
    """Shards of the two arrays in key order: (uri, least key, greatest key)."""

    hosts: list[tuple[str, int, int]]
    rules: list[tuple[str, int, int]]
    mask: int
    folders: list[str]

    def drop(self, spark: SparkSession) -> None:
        for f in self.folders:
            delete(spark, f)


class Prober:
    def __init__(self, index: Index):
        self.index, self.open = index, {}

    def _shard(self, uri: str) -> DigestArray:
        if uri not in self.open:
            if not _local(uri):
                self.open.clear()  # one at a time where a shard takes memory
            self.open[uri] = DigestArray(uri)
        return self.open[uri]

    def find(self, shards: list[tuple[str, int, int]], strings: list[bytes]) -> dict[bytes, bytes]:
        """The payloads of those strings that are there."""
        strings = list(dict.fromkeys(strings))
        keys = digests(strings, self.index.mask)
        order = np.argsort(keys)
        keys, out = keys[order], {}
        for uri, least, greatest in shards:
            a, b = np.searchsorted(keys, np.uint64(least)), np.searchsorted(keys, np.uint64(greatest), side="right")
            if a < b:
                some = [strings[i] for i in order[a:b]]
                out.update((s, p) for s, p in zip(some, self._shard(uri).find(some, keys[a:b])) if p is not None)
        return out

    def verdicts(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None, str]]:
        """(rule, listed, verdict) of each url: the longest rule that fits, the longest entry of the list that fits, and what they say."""
        tails = [_suffixes(h) for h in hosts]
        known = self.find(self.index.hosts, [t for own in tails for t in own])
        full: list[list[bytes]] = []
        for own, path in zip(tails, paths):
            p = path.encode("utf-8", "replace")
            full.append([t + p[:n] for t in own if t in known for n in np.frombuffer(known[t], "<u4").tolist() if n <= len(p)])
        hit = self.find(self.index.rules, [x for own in full for x in own])
        out = []
        for own in full:
            rule, listed = (max((x for x in own if hit.get(x, b"..")[k] != 46), key=len, default=None) for k in (0, 1))
            say = hit[rule][0] if rule is not None else hit[listed][1] if listed is not None else ord("a")
            out.append((rule and rule.decode(), listed and listed.decode(), "block" if say == ord("b") else "allow"))
        return out


def _suffixes(host: str) -> list[bytes]:
    """The host and its parent domains, longest first."""
    parts = host.encode("utf-8", "replace").split(b".")
    return [b".".join(parts[i:]) for i in range(len(parts)) if b".".join(parts[i:])]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, from after the first :// up to / ? # or the end; path from there up to ? # or the end; both empty without ://."""
    part = lambda k: F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)([^?#]*)", k)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def listed_hosts(pages: DataFrame, url_col: str = "url", parts: tuple[str, ...] = BAD_PARTS) -> DataFrame:
    """(host, path, verdict): a list of hosts to block, from the urls themselves.

    A host is listed where a label of it, or a hyphened piece of a label, is one of ``parts``; the entry is the shortest parent domain
    that still has such a label, so it covers its other subdomains too.
    """
    host = host_and_path(F.col(url_col))[0]
    labels = F.split("host", "\\.")
    bad = F.transform(labels, lambda x: F.arrays_overlap(F.split(x, "-"), F.array(*map(F.lit, parts))))
    last = F.size("bad") - F.array_position(F.reverse("bad"), True).cast("int") + 1
    hosts = pages.select(host.alias("host")).distinct().withColumn("bad", bad).where(F.exists("bad", lambda x: x))
    return hosts.select(F.array_join(F.slice(labels, last, F.size("bad")), ".").alias("host"), F.lit("").alias("path"), F.lit("block").alias("verdict")).distinct()


def _write_shards(scratch_path: str, rows: DataFrame, shards: int, mask: int) -> list[tuple[str, int, int]]:
    """rows (string binary, payload binary), strings distinct, as shards of key ranges; each task writes its own."""

    def run(batches):
        strings, payloads = [], []
        for b in batches:
            strings += b.column(1).to_pylist()
            payloads += b.column(2).to_pylist()
        if strings:
            # a task that runs again writes the same shard under the same name
            uri = f"{scratch_path}/{digests(strings, mask).min():016x}.digests"
            least, greatest = write_array(uri, strings, payloads, mask)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([str(least)]), pa.array([str(greatest)])], names=["uri", "least", "greatest"])

    key = F.xxhash64("string").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
    # unsigned order, as the files have it
    keyed = rows.select(key.bitwiseXOR(F.lit(-(1 << 63))).alias("key"), F.col("string").cast("binary").alias("string"), F.col("payload").cast("binary").alias("payload"))
    keyed = keyed.repartitionByRange(shards, "key")
    # a row a shard: about one for each 64 MB of the list
    made = keyed.mapInArrow(run, "uri string, least string, greatest string").collect()
    return sorted(((r.uri, int(r.least), int(r.greatest)) for r in made), key=lambda x: x[1])


def build_index(spark: SparkSession, rules: DataFrame, listed: DataFrame | None = None, mask: int = (1 << 64) - 1, shard_bytes: int = 64 << 20) -> Index:
    """The two arrays of ``rules`` and of a list, each (host, path, verdict: allow or block).

    Hosts are lower-cased, A-Z. Of contradictory rows for one host and path, block stands. Null or empty hosts and null
    verdicts make no rule, nor does a path that is neither empty nor begins with /, as no url has one; a null path is empty. Lists of any length: they are combined, dealt out by
    key and written by Spark, and only a row a shard comes to the driver.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host, path = F.translate(F.col("host").cast("string"), upper, upper.lower()), F.coalesce(F.col("path").cast("string"), F.lit(""))
    fits = (F.length("host") > 0) & ~F.contains("host", F.lit("/")) & ((F.length(path) == 0) | F.startswith(path, F.lit("/"))) & F.col("verdict").isin("allow", "block")
    use = lambda df, kind: df.where(fits).select(host.alias("host"), path.alias("path"), F.substring("verdict", 1, 1).alias(kind))
    both = use(rules, "rule").withColumn("listed", F.lit(None).cast("string"))
    if listed is not None:
        both = both.unionByName(use(listed, "listed").withColumn("rule", F.lit(None).cast("string")))
    with Scratch(spark) as scratch:
        # 'b' is after 'a'; '.' says that there is none of the kind
        entries = scratch.written(both.groupBy("host", "path").agg(*(F.coalesce(F.max(k), F.lit(".")).alias(k) for k in ("rule", "listed"))), "url-rules")
        size = entries.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0)).alias("size")).first().size
        shards = int(size // shard_bytes) + 1
        full = entries.select(F.concat("host", "path").alias("string"), F.concat("rule", "listed").alias("payload"))
        byte4 = lambda n: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))
        lengths = entries.select("host", F.octet_length("path").alias("n")).distinct().groupBy("host").agg(F.sort_array(F.collect_list("n")).alias("ns"))
        hosts = lengths.select(F.col("host").alias("string"), F.aggregate("ns", F.lit(b""), lambda a, n: F.concat(a, byte4(n))).alias("payload"))
        folders = [new_path(spark, "digests-hosts"), new_path(spark, "digests-rules")]
        index = Index(_write_shards(folders[0], hosts, shards, mask), _write_shards(folders[1], full, shards, mask), mask, folders)
        scratch.close()
        return index


_PROBERS: dict[str, Prober] = {}


def _prober(index: Index) -> Prober:
    """One a Python worker, of the index asked for last."""
    key = repr(index.folders)
    if key not in _PROBERS:
        _PROBERS.clear()
        _PROBERS[key] = Prober(index)
    return _PROBERS[key]


def url_verdicts(spark: SparkSession, pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest rule that fits decides, without one the longest entry of the list, without either a url is allowed.

    rule and listed are host and path together, null where none fits. A url that is null or has no
    :// has an empty host and path, which nothing fits: allowed. Repeated and null page_ids are rows of their
    own; a url of any length has as many probes as host labels and path lengths known for them; other columns are not read; an empty table gives no rows.
    """
    index = build_index(spark, rules, listed)
    names = ["page_id", "host", "path", "rule", "verdict", "listed"]

    def run(batches):
        prober = _prober(index)
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            rule, listed_, verdict = zip(*prober.verdicts(hosts, paths)) if hosts else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.string()) for x in (rule, verdict, listed_))], names=names)

    host, path = host_and_path(F.col(url_col))
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    with Scratch(spark) as scratch:
        out = scratch.keep(src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed string"), "url-verdicts")
    index.drop(spark)
    return out
