"""Chat formatting in budgeted, turn-aligned windows, in DataFrame expressions alone.

A conversation's turns are laid end to end on a line of tokens (prefix sums). What a window
has for new turns is ``budget - history`` less the tokens of the conversation's first system
turn: its room. Turns of more than half the room are windows of their own. The line is cut into
cells of the room less the longest other turn, and the turns that begin in one cell, between
two long ones, are a window's new turns; so they fit the room, whatever their lengths. A
window after the system turn begins with it, and then repeats as context the turns just before
the window that fit both ``history`` and what the budget has left. Only a window of one
new turn and no history can exceed the budget: where the system turn and that turn alone do.
Every turn is new in one window only; the loss mask covers the texts of new assistant
turns, never those of repeated ones.

    <|window|>                                  once, first
    <|turn new|>role<|text|>text<|end|>        a new turn
    <|turn old|>role<|text|>text<|end|>        a repeated one

Inside roles and texts a backslash is doubled, and then "<|" becomes "<\\|". Thus no
control string can occur in them and reading reverses it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, NEW, OLD, TEXT, END = "<|window|>", "<|turn new|>", "<|turn old|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """Words and signs: what a word-piece vocabulary would give at least. Any other long column may be used."""
    return F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]")).cast("long")


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256, overhead: int = 4, tokens=estimated_tokens) -> DataFrame:
    """conv_id, window, n_turns (new ones), n_tokens, text, loss (array of start and length in code points).

    ``turns`` has conv_id, turn, role, text. Null texts and roles are empty; a null conv_id
    is a conversation of its own, as null is a value. Turns go by number, nulls first; equal
    ones by role and then text. Turns are never cut. System turns after the first are turns like
    others. A turn of any length stays whole, in a window of its own if it must; rows that are there twice are two turns.
    An empty table gives no rows; other columns are not read.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tokens", tokens(F.col("text")) + overhead)
    one = Window.partitionBy("conv_id")
    by_place = one.orderBy("place")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("place", F.row_number().over(one.orderBy(*order)) - 1)
    t = t.withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    t = t.withColumn("first", F.min(F.when(F.col("role") == "system", F.struct(F.col("place").alias("place"), F.col("tokens").alias("tokens")))).over(one))
    t = t.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("first.tokens", F.lit(0))))
    t = t.withColumn("long", F.col("tokens") * 2 > F.col("room"))
    t = t.withColumn("longest", F.max(F.when(~F.col("long"), F.col("tokens"))).over(one))
    t = t.withColumn("span", F.struct(F.floor(F.col("at") / (F.col("room") - F.coalesce("longest", F.lit(0)))).alias("cell"), F.coalesce(F.sum(F.col("long").cast("long")).over(before), F.lit(0)).alias("longs"), "long"))
    # spans ascend along the line: a window begins where they change
    t = t.withColumn("begins", F.coalesce(F.col("span") != F.lag("span").over(by_place), F.lit(False)).cast("long"))
    t = t.withColumn("window", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.select("conv_id", "window", "place", "role", "text", "tokens", "at", "first")

    windows = t.groupBy("conv_id", "window").agg(F.min("at").alias("start"), F.min("place").alias("begin"), F.sum("tokens").alias("new"), F.first("first").alias("first"))
    later = F.coalesce(F.col("first.place") < F.col("begin"), F.lit(False))
    left = F.lit(budget) - F.col("new") - F.when(later, F.col("first.tokens")).otherwise(F.lit(0))
    windows = windows.select("conv_id", "window", "start", later.alias("later"), F.greatest(F.lit(0), F.least(F.lit(history), left)).alias("back"))
    row = ["place", "role", "text", "tokens"]
    shown = t.select("conv_id", "window", *row, F.lit(True).alias("new"))
    first = t.where("place = first.place").alias("s").join(windows.where("later").alias("w"), F.expr("s.conv_id <=> w.conv_id")).select("s.conv_id", "w.window", *(f"s.{c}" for c in row), F.lit(False).alias("new"))
    shown = shown.unionByName(first)
    if history:
        # what lies at most history before a window is in two cells of that size
        grid = lambda c: F.floor(F.expr(c) / history)
        reach = windows.where("back > 0 AND start > 0").withColumn("grid", F.explode(F.sequence(grid("start - back"), grid("start - 1"))))
        a, b = t.withColumn("grid", grid("at")).alias("a"), reach.alias("b")
        old = a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.grid = b.grid")).where("a.at < b.start AND b.start - a.at <= b.back AND NOT (a.place <=> a.first.place)")
        shown = shown.unionByName(old.select("a.conv_id", "b.window", *(f"a.{c}" for c in row), F.lit(False).alias("new")))

    body = F.struct(
        F.col("place"), F.col("new"), F.col("tokens"), (F.col("role") == "assistant").alias("target"),
        F.concat(F.when(F.col("new"), F.lit(NEW)).otherwise(F.lit(OLD)), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("text"),
    )
    w = shown.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(body)).alias("turns"))
    piece = lambda x: F.length(x.head) + F.length(x.text) + len(END)
    # where each turn's text begins: running sum of the lengths before it
    starts = F.aggregate(
        "turns", F.struct(F.lit(len(HEAD)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda s, x: F.struct((s.at + piece(x)).alias("at"), F.when(x.new & x.target, F.concat(s.loss, F.array(F.struct((s.at + F.length(x.head)).alias("start"), F.length(x.text).alias("length"))))).otherwise(s.loss).alias("loss")),
        lambda s: s.loss,
    )
    text = F.concat(F.lit(HEAD), F.array_join(F.transform("turns", lambda x: F.concat(x.head, x.text, F.lit(END))), ""))
    return w.select("conv_id", "window", F.size(F.filter("turns", lambda x: x.new)).alias("n_turns"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x.tokens).alias("n_tokens"), text.alias("text"), starts.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of new turns' role and text) and targets (texts under the mask), from the output alone."""
    parts = F.filter(F.split(F.substring(F.col("text"), len(HEAD) + 1, 2**31 - 1), F.lit("<\\|end\\|>"), -1), lambda x: F.startswith(x, F.lit(NEW)))
    turn = lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(NEW) + 1)), TEXT, 1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text"))
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s.start + 1, s.length)))
    return formatted.select("conv_id", "window", F.transform(parts, turn).alias("turns"), targets.alias("targets"), F.length("text").alias("chars"))
