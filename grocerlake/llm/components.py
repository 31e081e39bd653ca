"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of any comparable type to (node, component), the least node reachable.

    In turn each node's larger neighbours, then its smaller ones, are linked with its least
    neighbour, until nothing changes; the rounds needed grow with the logarithm of
    the longest path.  Each round is written in the shared folder.  No link stays on the driver; loops and
    repeated links do no harm; no links give no rows.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        # large star: all neighbours, both ways
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: only smaller neighbours remain, u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(small.distinct())
        # stars alone: no node is both a centre and a leaf
        done = after.select("u").intersect(after.select("v")).isEmpty()
        edges = after
        if done and after.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
