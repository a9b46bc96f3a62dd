"""Connected components by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.session import staged


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end hangs on one smaller end that hangs on nothing."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e"))
    tied = ends.groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
    return tied.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): root is the smallest node that it reaches.

    Each round hangs all larger neighbours of a node on its smallest neighbour, then all smaller ones; the
    number of rounds grows with the logarithm of the longest path. Minima are combined before they are
    shuffled, so a node may have any number of neighbours. Null nodes and loops are left out.
    """
    edges = edges.where((F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.distinct())
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = staged(larger.where("a <> b").distinct())
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        smaller = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
