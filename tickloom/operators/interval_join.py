"""Joining points to the intervals that hold them, as an equi-join.

A range join done naively tries every pair; with fixed buckets a long interval is repeated in every bucket it spans.
Here the ends of an interval go to their own buckets, and the buckets between are covered by at most two nodes for
each level of a binary tree, so an interval of any length becomes O(log length) rows. A point looks in its bucket and
in that bucket's ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 40


def join_points(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Pairs with start <= at < end and equal `by`. `at` counts from 0 or more; names must not clash beyond `by`."""
    first = F.floor(F.col(start) / bucket).cast("long")
    last = F.floor((F.col(end) - 1) / bucket).cast("long")
    ends = F.array_distinct(F.array(F.struct(F.lit(-1).alias("level"), first.alias("node")), F.struct(F.lit(-1).alias("level"), last.alias("node"))))
    lo, hi = first + 1, last

    def nodes(level):
        size = F.pow(F.lit(2.0), level).cast("long")
        a, b = F.ceil(lo / size).cast("long"), F.floor(hi / size).cast("long")
        cut = lambda odd, node: F.when((a < b) & (odd % 2 == 1), F.struct(level.alias("level"), node.alias("node")))
        return F.array_compact(F.array(cut(a, a), cut(b, b - 1)))

    middle = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), nodes))
    spread = F.when(last - first < 2, ends).otherwise(F.concat(ends, middle))
    left = intervals.where(F.col(start) < F.col(end)).withColumn("_node", F.explode(spread))
    left = left.withColumn("_level", F.col("_node.level")).withColumn("_node", F.col("_node.node"))
    own = F.floor(F.col(at) / bucket).cast("long")
    above = F.when(own >= 1, F.transform(F.sequence(F.lit(0), F.floor(F.log2(own)).cast("int")), lambda j: F.struct(j.alias("level"), F.floor(own / F.pow(F.lit(2.0), j)).cast("long").alias("node")))).otherwise(F.array())
    keys = F.concat(F.array(F.struct(F.lit(-1).alias("level"), own.alias("node"))), above)
    right = points.withColumn("_node", F.explode(keys)).withColumn("_level", F.col("_node.level")).withColumn("_node", F.col("_node.node"))
    return right.join(left, [*by, "_level", "_node"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_node")
