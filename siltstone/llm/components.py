"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps find the least neighbour of each node and join it back. The least neighbours are an aggregate, so a hub's
neighbours meet only after each task has reduced its own; they are written to the shared folder before the join, so
both sides of the join are plain shuffles, and adaptive execution splits the partition of a hub. Every plan is short
and a lost executor costs one step. After O(log n) rounds every node points at the least node of its component; the
rounds go on until nothing changes, and running out of them is an error, never a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import Scratch


def _large_star(e: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Neighbours above a node move to the least of the node and its neighbours."""
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = e.select(ways.alias("x")).select("x.u", "x.v")
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(e: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """A node and its neighbours below move to the least of them. ``e`` has the greater node in u."""
    least = scratch.keep(e.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    moved = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    return moved.where("u != v").distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 100) -> DataFrame:
    """From links (a, b) of longs: one row (node, component) per node that has a link; component is its least node."""
    figures = {"sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, state = scratch.measured(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0", **figures)
    for i in range(1, max_rounds + 1):
        if not state["rows"]:
            break
        large = scratch.keep(_large_star(edges, scratch, f"{name}-{i}a"), f"{name}-{i}a")
        edges, now = scratch.measured(_small_star(large, scratch, f"{name}-{i}b"), f"{name}-{i}", **figures)
        scratch.drop(f"{name}-{i}a", f"{name}-{i}a-least", f"{name}-{i}b-least", f"{name}-{i - 1}")
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    ends = F.explode(F.array_distinct(F.array("u", "v")))
    return edges.select(ends.alias("node"), F.col("v").alias("component")).distinct()
