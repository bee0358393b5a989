"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_back, materialize, release


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root points further."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("v"), F.lit(0), F.lit(1))
    )
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return odd.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for all nodes of ``edges``.

    Each round links every node's larger neighbours, then its smaller ones, to the least node
    around it; rounds grow with the logarithm of the longest chain. Minima are formed before
    the shuffle and no neighbourhood is ever collected, so a node with very many links is one
    row of the aggregate, and its edges are joined with that row where they are (``join_back``).
    Each round's edges are written to the shared folder, and the round before is deleted. Null
    ends and loops give no edge; an empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    while not _settled(now):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(now.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count(F.lit(1)).alias("n"))
        larger = join_back(both, least, "x", "n", 2 * now.count()).where(F.col("y") > F.col("x"))
        large = materialize(larger.select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_back(large, root, "u", "n", large.count()).where(F.col("v") != F.col("m"))
        after = materialize(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(root.select("u", "m")).distinct(), "edges")
        release(large, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v"), F.col("v")).distinct())
