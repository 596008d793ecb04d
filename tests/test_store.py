import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ballast.plans import runs
from ballast.sources import store

ROW = "k string, v string, at int"


def rows_of(v, spark):
    return sorted((r.k, r.v) for r in v.read(spark).collect())


def digests(root):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root, "parts").rglob("*.parquet")}


def merge(spark, root, rows, **more):
    return store.merge(spark, str(root), spark.createDataFrame(rows, ROW), "k", ["at"], **more)


def test_merges_equal_a_dict(spark, tmp_path):
    r, want, v = random.Random(4), {}, None
    for turn in range(6):
        rows = [(f"{r.randrange(400):04d}", r.choice("abc") if turn else "z", i) for i in range(r.choice([3, 300]))]
        want |= {k: x for k, x, _ in rows}
        v = merge(spark, tmp_path / "s", rows, range_rows=40)
        assert rows_of(v, spark) == sorted(want.items())
        lows = [x.low for x in v.ranges]
        assert lows[0] is None and lows[1:] == sorted(set(lows[1:])) and sum(x.rows for x in v.ranges) == len(want)
        for x, end in zip(v.ranges, [*lows[1:], None]):
            keys = [y.k for y in spark.read.parquet(x.folder).collect()]
            assert all((x.low is None or k >= x.low) and (end is None or k < end) for k in keys)
    assert max(x.rows for x in v.ranges) < 120 and len(v.ranges) > 3


def test_only_touched_ranges_are_rewritten(spark, tmp_path):
    a = merge(spark, tmp_path, [(f"{i:03d}", "old", 0) for i in range(200)], range_rows=30)
    before = digests(tmp_path)
    b = merge(spark, tmp_path, [("005", "new", 0), ("150", "old", 0)])
    assert (a.number, b.number) == (1, 2)
    assert [x for x in a.ranges if x not in b.ranges] == [a.ranges[0]] and len(b.ranges) == len(a.ranges)
    after = digests(tmp_path)
    assert all(after[p] == h for p, h in before.items())
    assert rows_of(store.version(spark, str(tmp_path), 1), spark) == [(f"{i:03d}", "old") for i in range(200)]


def test_what_is_stored_already_changes_nothing(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", None, 1), (None, "z", 1)]
    v = merge(spark, tmp_path, rows)
    assert sorted(rows_of(v, spark), key=str) == sorted([("a", "y"), ("b", None)], key=str)
    before = digests(tmp_path)
    for again in (rows, [("a", "x", 1), ("a", "y", 3)], [(None, "w", 1)], []):
        assert merge(spark, tmp_path, again) == v
    assert digests(tmp_path) == before


def test_empty_store(spark, tmp_path):
    assert store.version(spark, str(tmp_path / "none")) is None
    assert merge(spark, tmp_path / "none", []) is None and merge(spark, tmp_path / "none", [(None, "x", 1)]) is None


def test_a_second_writer_fails_and_harms_nothing(spark, tmp_path):
    v = merge(spark, tmp_path, [("a", "x", 1)])
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        store._publish(spark, str(tmp_path), [], v.schema, 1)
    assert store.version(spark, str(tmp_path)) == v and rows_of(v, spark) == [("a", "x")]


def test_vacuum_keeps_what_the_newest_names(spark, tmp_path):
    for i in range(3):
        v = merge(spark, tmp_path, [(f"{k:02d}", str(i), 0) for k in range(50) if i == 0 or k == 7], range_rows=10)
    want = rows_of(v, spark)
    assert store.vacuum(spark, str(tmp_path)) == 1
    assert store.version(spark, str(tmp_path), 1) is None and rows_of(store.version(spark, str(tmp_path)), spark) == want
    assert store.vacuum(spark, str(tmp_path)) == 0


def test_files_to_store(spark, tmp_path):
    root, text, page = str(tmp_path / "store"), tmp_path / "a.txt", tmp_path / "p.html"
    assert runs.ingest_files(spark, root, str(text), str(page)) is None
    page.write_text("<table><tr><th>x</th></tr><tr><td>7期</td><td>1 2 3 4 5 6</td><td>9</td></tr><tr><td>8</td><td>1 2 3 4 5 7</td><td>9</td></tr><tr><td>8</td><td>1 2 3 4 5 8</td><td>9</td></tr></table>")
    v = runs.ingest_files(spark, root, str(text), str(page))
    assert sorted(map(tuple, v.read(spark).select("issue", "draw_date", "reds", "blue").collect())) == [("7", None, "01,02,03,04,05,06", "09"), ("8", None, "01,02,03,04,05,08", "09")]
    text.write_text("7 2024-01-02 01 02 03 04 05 33 16 0 0\n9 2024-01-03 1 2 3 4 5 6 1\nbroken\n9 2024-01-04 1 2 3 4 5 6 2\n")
    v = runs.ingest_files(spark, root, str(text), str(page))
    got = {r.issue: (r.draw_date, r.blue) for r in v.read(spark).collect()}
    assert got == {"7": ("2024-01-02", "16"), "8": (None, "09"), "9": ("2024-01-04", "2")}
    assert runs.ingest_files(spark, root, str(text), str(page)) == v
    # a page without the text takes the date away again
    assert runs.ingest_files(spark, root, str(tmp_path / "none"), str(page)).read(spark).where("issue = '7'").select(F.isnull("draw_date")).first()[0]
