"""Breadth-first search over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bfs(edges: DataFrame, seeds: DataFrame, *, depth: int, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """node, depth: the nodes within ``depth`` steps of the seeds and their least distance; null nodes are left out.

    One join and one anti join for each level, so its work grows with the edges
    that a level touches.
    """
    hops = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).where("_src is not null and _dst is not null").distinct()
    level = seeds.select(F.col(node).alias("node")).where("node is not null").distinct()
    found = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = hops.join(level, F.col("_src") == F.col("node"), "left_semi").select(F.col("_dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        found = found.union(level.withColumn("depth", F.lit(d)))
    return found
