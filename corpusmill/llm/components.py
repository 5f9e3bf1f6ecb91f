"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

#: Tasks of a round at least, where their number follows the edges. A task keeps a hash table for every partition that it takes together.
LEAST_TASKS = 36


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool, tasks: int | None) -> DataFrame:
    """Every neighbour (large: the larger ones, small: the smaller ones) is tied to the least of a node and its neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least.withColumnRenamed("u", "_u"), F.col("u") == F.col("_u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u != v")
    return (out.coalesce(tasks).distinct().coalesce(tasks)) if tasks else out.distinct()


def components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """node, root: for each node with an edge in `edges` (u, v; long), the least node that it reaches.

    Each round costs a few shuffles of the edges, and the number of rounds grows with the logarithm of the graph.
    Loops and repeated edges do not matter; no edges: no rows. `task_edges`: how many edges a task should work on; then a
    small graph does not leave files for every shuffle partition behind in each round (LEAST_TASKS tasks at least).
    """
    now = cut_lineage(edges.select("u", "v").where("u != v").distinct())
    tally = _tally(now)
    tasks = max(LEAST_TASKS, tally[0] // task_edges) if task_edges else None
    while tally[0]:
        now = cut_lineage(_stars(_stars(now, True, tasks), False, tasks))
        before, tally = tally, _tally(now)
        if before == tally:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
