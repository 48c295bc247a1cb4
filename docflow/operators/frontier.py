"""Breadth-first traversal of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.plans.workspace import Workspace


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``seeds`` (node), ``edges`` (src, dst) -> (node, depth): each node once, at its least depth.

    A level joins the nodes found last with the edges, and an anti join drops what was seen. Null nodes are nowhere. ``max_depth``: None
    follows the links to their end."""
    work = Workspace(seeds.sparkSession, "frontier")
    level = work.save(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    visited, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node is not null").distinct()
        level = work.save(found.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited
