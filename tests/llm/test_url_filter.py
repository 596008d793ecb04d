import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm import url_filter as u

RULE = "host string, path string, verdict string"
URL = "page_id long, url string"


def brute(urls, rules, listed=()):
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    out = []
    for k, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = low(rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = lambda rs: sorted(((len((low(h) + p).encode()), len(h), low(h) + p, v) for h, p, v in rs if h and host and ("." + host).endswith("." + low(h)) and path.startswith(p) and (not p or p[0] == "/")), key=lambda x: (x[0], x[1], x[3]))
        a, b = fits(rules), fits(listed)
        out.append((k, host, path, a[-1][2] if a else None, (a or b or [(0, 0, "", "allow")])[-1][3]))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    r = random.Random(5)
    names = ["a", "b", "c-d", "é", "net", "x"]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randint(1, 4)))
    path = lambda: r.choice(["", "/", "/a", "/a/", "/a/b", "/é/", "/ab", "no"])
    rules, listed = ([(host(), path(), r.choice(["allow", "block"])) for _ in range(60)] for _ in range(2))
    urls = [(i, r.choice(["http", "https", "HTTP"]) + "://" + r.choice([host(), host().upper()]) + path() + r.choice(["", "?q=/a", "#/a", "/a/b?x#y"])) for i in range(400)]
    urls += [(1, urls[1][1]), (None, "http://a"), (400, None), (401, ""), (402, "no scheme"), (403, "://"), (404, "x://a//b://c/"), (405, "http://.a./"), (406, "http://" + "b." * 60 + "a/" + "p" * 50_000), (407, "http:\n//a\n://b/\nc")]
    df = spark.createDataFrame([(*x, "z") for x in urls], URL + ", host string")
    out = u.url_verdicts(spark, df, spark.createDataFrame(rules, RULE), spark.createDataFrame(listed, RULE))
    assert got(out) == brute(urls, rules, listed)


def test_rules_that_contradict_or_say_nothing(spark):
    rules = [("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("b.com", None, "block"), ("c.com", "/", None), ("d.com", "/", "maybe"), ("d.com/e", "", "block")]
    urls = [(i, f"http://{h}.com/e") for i, h in enumerate("abcd")]
    out = u.url_verdicts(spark, spark.createDataFrame(urls, URL), spark.createDataFrame(rules, RULE))
    assert [(r.rule, r.verdict) for r in out.orderBy("page_id").collect()] == [("a.com/", "block"), ("b.com", "block"), (None, "allow"), (None, "allow")]


def test_empty_tables(spark):
    none, rules = spark.createDataFrame([], URL), spark.createDataFrame([], RULE)
    assert u.url_verdicts(spark, none, rules, u.listed_hosts(none)).count() == 0
    assert u.url_verdicts(spark, spark.createDataFrame([(1, "http://a/")], URL), rules).first().verdict == "allow"


@pytest.mark.parametrize("bits", [0, 3, 64])
def test_collisions_are_told_apart_by_text(tmp_path, bits):
    mask = (1 << bits) - 1
    words = [f"host{i}".encode() for i in range(300)]
    uri = f"file://{tmp_path}/one.digests"
    u.write_array(uri, words, [w[::-1] for w in words], mask)
    arr = u.DigestArray(uri)
    asked = [*words, b"host300", b"", b"host"]
    assert arr.find(asked, u.digests(asked, mask)) == [w[::-1] for w in words] + [None] * 3
    assert isinstance(arr.keys, np.memmap)


def test_long_lists_in_many_shards(spark):
    rules = spark.range(20_000).select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    index = u.build_index(spark, rules, shard_bytes=100_000)
    assert len(index.rules) > 5
    assert all(a[2] < b[1] for a, b in zip(index.rules, index.rules[1:]))
    p = u.Prober(index)
    say = p.verdicts([f"www.h{i}.net" for i in range(0, 40_000, 100)], ["/x"] * 400)
    assert [v for _, _, v in say] == ["block"] * 200 + ["allow"] * 200
    index.drop(spark)


def test_list_of_hosts(spark):
    urls = [(1, "http://m.casino-win.example.com/"), (2, "http://casino-win.example.com"), (3, "http://good.org/casino"), (4, "http://a.ads.b.spam.org/x"), (5, "http://adsense.org/"), (6, None)]
    out = u.listed_hosts(spark.createDataFrame(urls, URL))
    assert sorted(r.host for r in out.collect()) == ["casino-win.example.com", "spam.org"]
