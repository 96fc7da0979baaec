"""Connected components by alternating star contractions, as DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolink.llm.shared import discard, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every greater neighbour of a node is linked to the least node around it. Small star: the lesser ones, and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one lesser node at most, and none that is linked to is itself linked to another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where("up > 1 OR up = 1 AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of edges (u, v long); saved.

    Loops until the edges are stars, a number of rounds that grows with the logarithm of the longest path. Self-loops
    and repeated edges don't matter; no edges give no rows. edges is read twice in the first round.
    """
    now = edges.where("u <> v").select("u", "v")
    while True:
        new = save(_star(_star(now, True), False).distinct(), "edges")
        discard(now)
        now = new
        if _are_stars(now):
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
