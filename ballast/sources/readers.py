"""Readers and writers of the engine's file formats. Everything opens by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.schema import CSV_HEADER, DRAW_CSV
from ballast.sources.files import landed_lines
from ballast.sources.markup import first_table

_TRIM = "^\\s+|\\s+$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text history lines -> issue, draw_date, reds, blue (strings), for the lines that are records.

    White-space separated, nine fields at least, an all-digit issue, a date of three parts;
    numbers are not checked further, and further fields are ignored.
    """
    # most lines of prose end here, before any pattern is tried
    begins = F.substring(F.ltrim(column, F.lit(" \t\n\x0b\f\r")), 1, 1).between("0", "9")
    f = F.split(F.regexp_replace(F.col(column), _TRIM, ""), "\\s+")
    # one element: a generator's output is computed once a line, where a filter would repeat the split for each test
    rows = lines.where(begins).select("*", F.explode(F.array(f)).alias("_f")).where((F.size("_f") >= 9) & F.get("_f", F.lit(0)).rlike("^[0-9]+$") & (F.size(F.split(F.get("_f", F.lit(1)), "-")) == 3))
    g = lambda i: F.get("_f", F.lit(i))
    return rows.select(*lines.columns, g(0).alias("issue"), g(1).alias("draw_date"), F.array_join(F.slice("_f", 3, 6), ",").alias("reds"), g(8).alias("blue")).drop(column)


def in_file_order(lines: DataFrame) -> DataFrame:
    """Rows of a text reader with file and seq, by which later ones of a file are greater."""
    return lines.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))


def read_text_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed text files; none where the download left nothing."""
    lines = landed_lines(spark, path)
    return parse_lines(lines.where(F.length(F.trim("value")) > 0))


def table_cells(html: Column) -> Column:
    """Rows of the first table after its header, each an array of cell texts."""
    return F.slice(first_table(html), 2, 1 << 30)


def parse_html(pages: DataFrame, column: str = "html", numbered: str | None = None) -> DataFrame:
    """First tables -> issue, reds, blue (strings, no date): three cells, a digit issue, six numbers, a blue of 1 to 16.

    numbered: a column of ``pages`` that takes the number of the row in its table.
    """
    rest = [c for c in pages.columns if c not in (column, numbered)]
    rows = pages.select(*rest, F.posexplode(table_cells(F.col(column))).alias(numbered or "_row", "c")).where(F.size("c") >= 3)
    issue, blue = F.replace(F.get("c", F.lit(0)), F.lit("期"), F.lit("")), F.get("c", F.lit(2))
    balls = F.transform(F.split(F.get("c", F.lit(1)), " "), lambda x: x.try_cast("int"))
    out = rows.select("*", issue.alias("issue"), balls.alias("_balls"), blue.try_cast("int").alias("_blue"))
    good = F.col("issue").rlike("^[0-9]+$") & (F.size("_balls") == 6) & F.forall("_balls", lambda x: x.isNotNull()) & F.col("_blue").between(1, 16)
    return out.where(good).select(*(c for c in pages.columns if c != column), "issue", F.array_join(F.transform("_balls", lambda x: F.lpad(x.cast("string"), 2, "0")), ",").alias("reds"), F.lpad(F.col("_blue").cast("string"), 2, "0").alias("blue"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return parse_html(spark.read.text(path, wholetext=True).withColumnRenamed("value", "html"))


def read_draw_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Raw strings by position, whatever the header says."""
    return spark.read.csv(path, schema=DRAW_CSV, header=True, encoding=encoding, enforceSchema=True)


def read_draw_csv_any(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, else as bytes where they are not UTF-8, as GBK's are not; an empty file is an empty frame.

    GBK's second bytes are none of the signs that CSV is made of, and the cells that
    typed_draws() reads are ASCII, so one character a byte (ISO-8859-1) loses nothing of them
    and needs no setting of the session. The test reads lines as text, where bad bytes show as U+FFFD.
    """
    bad = not spark.read.text(path).where(F.contains("value", F.lit("\ufffd"))).isEmpty()
    return read_draw_csv(spark, path, "ISO-8859-1" if bad else "UTF-8")


def typed_draws(raw: DataFrame) -> DataFrame:
    """Raw strings -> issue long, draw_date date, reds sorted array<int>, blue int; text that is no number becomes null."""
    reds = F.array_sort(F.transform(F.split("reds", ","), lambda x: F.trim(x).try_cast("int")))
    return raw.select(F.col("issue").try_cast("long").alias("issue"), F.expr("try_to_date(draw_date, 'yyyy-MM-dd')").alias("draw_date"), reds.alias("reds"), F.trim("blue").try_cast("int").alias("blue"))


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    """typed_draws() of CSV in UTF-8 or GBK, in one pass.

    All cells that become values are ASCII in either encoding, and no byte of another sign is a comma, a quote or a line's end, so a
    character a byte reads both without a test of which it is.
    """
    return typed_draws(read_draw_csv(spark, path, "ISO-8859-1"))


def write_draw_csv(rows: DataFrame, path: str) -> None:
    """A directory of UTF-8 CSV with the fixed header, quoted only where needed, ordered by issue as text."""
    named = rows.select(*(F.col(a).alias(b) for a, b in zip(DRAW_CSV.fieldNames(), CSV_HEADER)))
    named.orderBy(CSV_HEADER[0]).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
