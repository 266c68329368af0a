"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import durable

#: Edges that a task takes; a small table isn't spread over more tasks than it has work for.
EDGES_A_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, root) for each node of an edge; root is the smallest node reachable.

    Every step is an aggregation and an equality join; nothing but the counts that tell the end
    reaches the driver. Null ends and loops are ignored; an empty table gives an empty result.
    """
    edges = edges.where(F.col("u") != F.col("v"))
    edges = durable(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    tasks = edges.count() // EDGES_A_TASK + 1
    before = None
    while True:
        edges = durable(_small_star(_large_star(edges.coalesce(tasks), tasks), tasks).coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Larger neighbours of each node are tied to the node's smallest neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * tasks)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
    tied = both.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u").coalesce(tasks)
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Smaller neighbours of each node, and the node, are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    tied = edges.join(low.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
