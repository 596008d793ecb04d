"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a join and an aggregate over the edges; a hub's edges are never gathered:
its minimum is a partial aggregate and goes back to its edges by a join that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm._shared import Scratch


def _are_stars(e: DataFrame) -> bool:
    """Whether every leaf has one centre and no centre is a leaf, in one aggregate of partial sums."""
    ends = e.selectExpr("stack(2, u, 1L, v, 0L) AS (x, leaf)").groupBy("x").agg(F.sum("leaf").alias("centres"), F.min("leaf").alias("both"))
    return not ends.agg(F.coalesce(F.max((F.col("centres") > 1) | ((F.col("centres") > 0) & (F.col("both") == 0))), F.lit(False))).first()[0]


def star_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges as (u, v) with u > v; nulls and loops are dropped, direction and repeats do not matter."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    return e.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()


def stars(scratch: Scratch, edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """The table (u, v) of each node u and the least node v reachable from it, for nodes with a lesser one; edges as of star_edges()."""
    e = scratch.written(edges, "edges")
    for _ in range(max_steps):
        if _are_stars(e):
            return e
        # large star: the larger neighbours of each node join its least neighbour
        both = e.selectExpr("stack(2, u, v, v, u) AS (u, v)")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its smaller neighbours join the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("stack(2, v, m, u, m) AS (u, v)").where("u <> v").distinct()
        nxt = scratch.written(small, "edges")
        scratch.drop(e)
        e = nxt
    raise RuntimeError("components did not settle")


def labels(e: DataFrame) -> DataFrame:
    """(node, component) of each node in stars()."""
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node with an edge to another; component is the least node reachable."""
    return labels(stars(scratch, star_edges(edges, a, b)))
