"""Shared-folder tables and Hadoop-neutral file access for the corpus operators.

Driver and executors share only the folder named by ``spark.checkpoint.dir``, the
warehouse and the inputs. Everything an operator materialises goes through here.
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where unset, a local master (as in tests) gets a fresh one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", master := spark.sparkContext.master):
            raise RuntimeError(f"spark.checkpoint.dir is unset: executors under {master} share no other folder")
        found = f"file://{tempfile.mkdtemp(prefix='ballast-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ballast/{name}-{uuid.uuid4().hex}"


#: An operator's table has at most so many files, or so many for each core, or one for so many shuffle partitions, whichever is most.
FILES, FILES_A_CORE, PARTITIONS_A_FILE = 64, 4, 8


def written(spark: SparkSession, df: DataFrame, name: str, merged: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives the loss of any executor.

    merged: small partitions go to fewer files, by tasks that take them one after the other, as each file costs the
    store some calls, and a local one a process that sets its permissions. There is work for all cores several times over, and tasks
    grow in number with the shuffle partitions that the session has for its data. Not for plans whose last stage asks for its
    partition's number, which merging changes.
    """
    path = new_path(spark, name)
    if merged:
        df = df.coalesce(max(FILES, FILES_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ballast_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_ballast_path", None):
            delete(spark, path)


#: Paths of results that operators have kept in this process.
_KEPT: list[str] = []


@contextlib.contextmanager
def results_dropped(spark: SparkSession):
    """Deletes, at its end, the results that operators kept meanwhile: for a step that writes what it makes of them."""
    n = len(_KEPT)
    yield
    while len(_KEPT) > n:
        delete(spark, _KEPT.pop())


class Scratch:
    """The tables and folders of one call of an operator; keep() writes its result, and what is left goes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out = written(self.spark, df, name, merged=True)
        self.paths.append(out._ballast_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._ballast_path)
            self.paths.remove(t._ballast_path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The result as a table, which kept() knows; the others are deleted."""
        out = written(self.spark, df, name, merged=True)
        _KEPT.append(out._ballast_path)
        self.close()
        return out

    def close(self) -> None:
        for p in self.paths:
            delete(self.spark, p)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        if failed[0]:
            self.close()


def small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few; else as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, by Spark's own rule for equal names."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


@contextlib.contextmanager
def create_file(uri: str):
    """Writes ``uri`` by way of a temporary name, so that a file under its own name is complete."""
    tmp = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(tmp), "wb") as f:
            yield f
        os.replace(_local(tmp), path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        at = fs.FileSystem.from_uri(tmp)[1]
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(at) as f:
            yield f
        store.move(at, path)


def open_file(uri: str):
    """A seekable binary file, local or of any store that pyarrow reaches."""
    if (path := _local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def ship(spark: SparkSession) -> None:
    """Lets executors import this package where they don't find it by PYTHONPATH: a zip by Spark's own file server."""
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if getattr(sc, "_ballast_shipped", False) or root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ballast-"), "ballast.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "ballast")):
            for x in names:
                if x.endswith(".py"):
                    z.write(at := os.path.join(top, x), os.path.relpath(at, root))
    sc.addPyFile(path)
    sc._ballast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
