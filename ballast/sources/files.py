"""Files that the engine itself lands: a shared folder for tables between plans, and small text files."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir; a local master may lack one, a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: executors share no other folder")
        folder = f"file://{tempfile.mkdtemp(prefix='ballast-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/ballast/{name}-{uuid.uuid4().hex}"


#: Paths that this process has made for its plans, and not deleted yet.
_MADE: list[str] = []


def made_path(spark: SparkSession, name: str) -> str:
    """A fresh shared path that goes with cleared() or with the process."""
    if not _MADE:
        atexit.register(_forget, spark)
    _MADE.append(shared_path(spark, name))
    return _MADE[-1]


def materialised(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, for plans that read it in several branches; it goes with cleared() or with the process."""
    path = made_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """Deletes, at its end, the tables that plans made meanwhile: around what reads their results."""
    n = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > n:
            delete(spark, _MADE.pop())


def _forget(spark: SparkSession) -> None:
    """At the end of the process, if the session is still up."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            while _MADE:
                delete(spark, _MADE.pop())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; one with wildcards, whether it matches anything."""
    p, fs = _hadoop(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def landed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of text files that a download has left; none where nothing was left."""
    return spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """One UTF-8 file of a few kilobytes, by Hadoop's own API; complete under its name or not there."""
    p, fs = _hadoop(spark, path)
    part, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"could not write {path}")
    return path
