"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    own = least.select("u", F.col("m").alias("v"))
    return own.unionByName(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(u, v)``: the root is the least node of its component.

    Rounds go as the logarithm of the longest path. Each writes its edges to the shared folder; only a count and a
    checksum reach the driver. An edge is two longs, so below the size at which the adaptive skew join splits a partition,
    a node of millions of edges is still a small task; above it, it is split.
    """
    now = materialize(edges.where("u != v").select("u", "v").distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        now = materialize(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
