"""Decayed running totals at any number of steps, from one pass over the events.

The total at step s is the sum of weight * decay^(s - 1 - idx) over the events before s. Two states
combine: an earlier one of weight w, followed by ``length`` positions of weight v, is w * decay^length + v,
whichever way a longer stretch is cut. So positions are cut into chunks; an aggregate gives each
chunk's state, a window over the chunks folds the states before each, and a window inside
the chunk adds what it has itself. No step meets the events of another chunk. Where the first and last step
are known, chunks begin there, and all that lies before is one state a key, added up by the tasks that read it.

Where every key is asked at every step, ``slot_totals`` shuffles a row a position, not one a key and step: the keys are bits of it.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
#: A row of slot_totals' window has two numbers a key, and a chunk with the state before it stays within the window's buffer of rows.
SLOT_CHUNK = 4000
#: Powers of the decay within a chunk stay under e^500; states whose weight is under e^-45 of the newest one's are not folded.
_SPAN, _REACH = 500, 45


def chunk_of(decay: float, chunk: int = CHUNK) -> int:
    """A chunk's length, shorter where the decay is so strong that its powers would leave a double's range."""
    return max(1, min(chunk, int(_SPAN / -log(decay)))) if decay < 1 else chunk


def _carried(states: DataFrame, keys: list[str], decay: float, size: int) -> DataFrame:
    """keys, _chunk, and the total _w and position _last that the states of earlier chunks leave before it."""
    power = lambda e: F.pow(F.lit(float(decay)), e)
    before = Window.partitionBy(*keys).orderBy("_chunk")
    if decay == 1:
        carried = F.sum("_w").over(before.rowsBetween(Window.unboundedPreceding, -1))
    else:
        reach = ceil(_REACH / (-log(decay) * size)) + 1
        held = F.collect_list(F.struct("_chunk", "_w")).over(before.rangeBetween(-reach, -1))
        carried = F.aggregate(held, F.lit(0.0), lambda a, x: a + x["_w"] * power((F.col("_chunk") - x["_chunk"] - 1) * size))
    last = F.max("_last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    return states.select(*keys, "_chunk", carried.alias("_w"), last.alias("_last"))


def running_totals(events: DataFrame, queries: DataFrame, keys: list[str], decay: float = 1.0, chunk: int = CHUNK, steps: tuple[int, int] | None = None) -> DataFrame:
    """queries with total (0 without events) and last (the greatest idx before the step, null without events).

    events: keys, idx, weight. queries: keys, step and more. Both by any number of rows of a key; an event
    counts for steps after its idx. Work and shuffles are a row an event and a query; a window holds one chunk of a key,
    or a key's chunk states, a row for ``chunk`` positions. steps: the least and greatest step of queries; then events before it are a row
    a key and task, and those after it are left out. ``events`` is read twice, the second time from the first step on.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be in (0, 1]")
    size = chunk_of(decay, chunk)
    # the first position of chunk 0
    origin = steps[0] - 1 if steps else 0
    at = lambda c: F.floor((F.col(c) - origin) / size).cast("long")
    power = lambda e: F.pow(F.lit(float(decay)), e)
    within = at("idx")
    if steps:
        # nothing is asked before chunk 0
        events, within = events.where(F.col("idx") < steps[1]), F.greatest(within, F.lit(-1).cast("long"))
    events = events.select(*keys, F.col("idx").cast("long").alias("_at"), F.col("weight").cast("double").alias("_w"), within.alias("_chunk"))
    # a step sees the chunk of the position before it, and carries what earlier chunks leave
    asked = queries.withColumn("_at", F.col("step").cast("long") - 1).withColumn("_chunk", at("_at"))
    own = events.groupBy(*keys, "_chunk").agg(F.sum(F.col("_w") * power(origin + (F.col("_chunk") + 1) * size - 1 - F.col("_at"))).alias("_w"), F.max("_at").alias("_last"))
    none = asked.select(*keys, "_chunk", F.lit(0.0).alias("_w"), F.lit(None).cast("long").alias("_last")).distinct()
    states = own.unionByName(none).groupBy(*keys, "_chunk").agg(F.sum("_w").alias("_w"), F.max("_last").alias("_last"))
    carry = _carried(states, keys, decay, size)
    # events of chunks that no step asks for end here
    if steps:
        carry, near = carry.where("_chunk >= 0"), events.where(F.col("_at") >= origin)
    else:
        wanted = asked.select("_chunk").distinct()
        carry, near = carry.join(wanted, "_chunk", "left_semi"), events.join(wanted, "_chunk", "left_semi")
    rest = [c for c in asked.columns if c not in (*keys, "_at", "_chunk")]
    blank = [F.lit(None).cast(t).alias(c) for c, t in asked.select(*rest).dtypes]
    line = lambda df, order, w, l, extra: df.select(*keys, "_chunk", "_at", F.lit(order).alias("_order"), w.alias("_w"), l.cast("long").alias("_last"), *extra)  # noqa: E731, E741
    rows = line(carry.withColumn("_at", origin + F.col("_chunk") * size - 1), 0, F.coalesce("_w", F.lit(0.0)), F.col("_last"), blank)
    rows = rows.unionByName(line(near, 1, F.col("_w"), F.col("_at"), blank))
    rows = rows.unionByName(line(asked, 2, F.lit(0.0), F.lit(None), rest))
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.sum(F.col("_w") * power(origin + F.col("_chunk") * size - F.col("_at"))).over(upto) * power(F.col("_at") - origin - F.col("_chunk") * size)
    out = rows.select(*keys, *rest, "_order", scaled.alias("total"), F.max("_last").over(upto).alias("last"))
    return out.where("_order = 2").drop("_order")


def slot_totals(events: DataFrame, slots: list[Column], steps: tuple[int, int], decay: float = 1.0, chunk: int = SLOT_CHUNK) -> DataFrame:
    """step, the fields of ``slots``, total and last, as running_totals has them: a row for each slot at each step from steps[0] to steps[1].

    events: idx and bits, in which bit i is an event of weight 1 of the i-th slot; by any number of rows of an idx. slots: constant
    structs, 63 at most. Shuffled and sorted are a row an event and a state a slot and chunk; the rows a slot and step are made after that.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be in (0, 1]")
    size, (first, end), n = chunk_of(decay, chunk), steps, len(slots)
    origin = first - 1
    power = lambda e: F.pow(F.lit(float(decay)), e)
    start = origin + F.col("_chunk") * size
    number = F.explode(F.array(*map(F.lit, range(n)))).alias("_slot")
    at = F.col("idx").cast("long")
    events = events.where(at < end).select(at.alias("_at"), F.col("bits").cast("long").alias("_bits"), F.greatest(F.floor((at - origin) / size).cast("long"), F.lit(-1).cast("long")).alias("_chunk"))
    own = events.select("_chunk", "_at", "_bits", power(start + size - 1 - F.col("_at")).alias("_w"), number).where("shiftright(_bits, _slot) & 1 = 1")
    own = own.groupBy("_slot", "_chunk").agg(F.sum("_w").alias("_w"), F.max("_at").alias("_last"))
    none = events.sparkSession.range(0, (end - first) // size + 1).select(number, F.col("id").alias("_chunk"), F.lit(0.0).alias("_w"), F.lit(None).cast("long").alias("_last"))
    states = own.unionByName(none).groupBy("_slot", "_chunk").agg(F.sum("_w").alias("_w"), F.max("_last").alias("_last"))
    carry = _carried(states, ["_slot"], decay, size).where("_chunk >= 0").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    carry = carry.groupBy("_chunk").agg(F.sort_array(F.collect_list(F.struct("_slot", "_w", "_last"))).alias("_s"))
    carry = carry.select("_chunk", (start - 1).alias("_at"), F.lit(0).cast("long").alias("_bits"), F.col("_s._w").alias("_sums"), F.col("_s._last").alias("_lasts"))
    near = events.where(F.col("_at") >= origin).select("_chunk", "_at", "_bits", F.lit(None).cast("array<double>").alias("_sums"), F.lit(None).cast("array<bigint>").alias("_lasts"))
    # sorted before the window's arguments, two columns a slot, are made; by number, as a small shuffle joined to one task still makes many rows
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = carry.unionByName(near).repartition(parts, "_chunk").sortWithinPartitions("_chunk", "_at").withColumn("_scale", power(start - F.col("_at")))
    inside = Window.partitionBy("_chunk").orderBy("_at")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bit = lambda i: F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0
    sums = F.array(*(F.sum(F.when(bit(i), F.col("_scale")).otherwise(F.get("_sums", F.lit(i)) * F.col("_scale"))).over(upto) for i in range(n)))
    lasts = F.array(*(F.max(F.when(bit(i), F.col("_at")).otherwise(F.get("_lasts", F.lit(i)))).over(upto) for i in range(n)))
    # a row stands for the positions up to the next one's
    until = F.coalesce(F.lead("_at").over(inside), F.least(start + size, F.lit(end)))
    held = rows.select(start.alias("_start"), F.greatest("_at", start).alias("_from"), until.alias("_until"), sums.alias("_sums"), lasts.alias("_lasts")).where("_from < _until")
    held = held.select("_start", "_sums", "_lasts", F.explode(F.sequence(F.col("_from"), F.col("_until") - 1)).alias("_at"))
    held = held.select((F.col("_at") + 1).alias("step"), power(F.col("_at") - F.col("_start")).alias("_scale"), "_sums", "_lasts")
    held = held.select("step", "_scale", "_sums", "_lasts", F.posexplode(F.array(*slots)).alias("_slot", "_key"))
    return held.select("step", "_key.*", (F.get("_sums", F.col("_slot")) * F.col("_scale")).alias("total"), F.get("_lasts", F.col("_slot")).alias("last"))
