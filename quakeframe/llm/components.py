"""Connected components by repeated contraction, on written tables.

Each round every vertex points at the smallest vertex of its closed neighbourhood, in
the order of ids (even rounds) or of a seeded hash (odd rounds, which shrink any graph
by a constant factor in expectation); then edges move to what their ends point at.
Minimum per vertex is a partial aggregate, so a hub's edges never gather in a task; the
joins that move edges are plain equi-joins that adaptive execution splits when skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node.

    Self-loops, repeated edges and nulls are ignored; no edges give no rows.  root is
    one node of the component, the same for all of its nodes.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = durable(pairs.union(pairs.select("b", "a")).distinct())
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        k = len(maps)
        order = (lambda c: c) if k % 2 == 0 else (lambda c, k=k: F.xxhash64(c, F.lit(k)))
        low = pairs.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("m"))
        points = durable(
            low.select("a", F.when(order(F.col("m")) < order(F.col("a")), F.col("m")).otherwise(F.col("a")).alias("p"))
        )
        maps.append(points)
        left = points.select("a", F.col("p").alias("pa"))
        right = points.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = pairs.join(left, "a").select("pa", "b").join(right, "b").where("pa <> pb")
        before, pairs = pairs, durable(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        discard(before)
    if not maps:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = maps[-1].select("a", "p")
    for points in reversed(maps[:-1]):
        deeper = root.select(F.col("a").alias("p"), F.col("p").alias("q"))
        root = points.join(deeper, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    found = durable(root.select(F.col("a").alias("node"), F.col("p").alias("root")))
    discard(pairs, *maps)
    return found
