"""Connected components by alternating large-star and small-star steps, in DataFrame operations.

An edge table shrinks to stars around each component's smallest id in a logarithmic number of rounds. A node's
neighbours are never gathered: a round takes minima (summed before the shuffle) and joins them back, so a hub with a
third of all edges is split like any skewed join. Each round is written to the shared folder, which cuts lineage.
A table of at most `IN_ONE_TASK` edges (a few MB) is settled by union-find in one task instead, with equal results:
rounds over so little would be all scheduling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut, discard


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these. Edges run from larger u to smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


IN_ONE_TASK = 200_000


def united(batches):
    """node, component of all edges of the batches, by union-find towards the smallest id."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            x, y = find(u), find(v)
            parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(parent), "component": [find(x) for x in parent]}, dtype="int64")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60, in_one_task: int | None = None) -> DataFrame:
    """node, component (its smallest id) for every node that has an edge to another; edges have long ids."""
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    if now.count() <= (IN_ONE_TASK if in_one_task is None else in_one_task):
        return now.coalesce(1).mapInPandas(united, "node long, component long")
    mark = None
    for _ in range(most_rounds):
        new = cut(small_star(large_star(now)))
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = new
        if sums == mark:
            break
        mark = sums
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
