"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docflow.llm.workspace import Workspace


def spanning_edges(close: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """Edges that connect what the links ``close`` of two blocks of nodes connect: a spanning forest, not all links.

    ``same``: both blocks are one."""
    names = left if same else np.concatenate([left, right])
    offset = 0 if same else len(left)
    seen = np.zeros(len(names), dtype=bool)
    for start in range(len(left)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            at = queue.pop()
            if same or at < len(left):
                near = np.flatnonzero(close[at]) + offset
            else:
                near = np.flatnonzero(close[:, at - len(left)])
            near = near[~seen[near]]
            seen[near] = True
            for x in near.tolist():
                yield int(names[at]), int(names[x])
                queue.append(x)


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges`` (a, b) -> (node, component): component is the smallest node that can be reached.

    Each round relinks nodes to the smallest neighbour; the number of rounds grows with the logarithm of the longest
    path. Only minima per node are aggregated (with map-side combine) and joined back, so a hub is split like any
    skewed join. Nodes without edges aren't in the result; loops and null ends are ignored.
    """
    flat = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = work.save(flat.where("a <> b").distinct())
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        small = small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        following = work.save(small)
        after = _state(following)
        work.drop(current)
        current = following
        if after == state:
            break
        state = after
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(a % 1000003)"), F.expr("sum(b % 1000003)")).first()
    return tuple(row)
