"""Connected components by alternating star steps, on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of the component of every node in ``edges`` (``a, b``)."""
    pairs, _ = stars(edges)
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def stars(edges: DataFrame) -> tuple[DataFrame, str]:
    """``a, b``: every node but the least of its component with that least node, and the folder they are stored in.

    Each round ties every larger neighbour of a node to its least neighbour, then every
    smaller one, until the edges form stars. Only one count a round reaches the driver.
    Each round stores its edges and deletes those of the one before. Stars that are known
    may stand among the edges: new ones between them then take few rounds.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, folder = stored(pairs)
    while not _are_stars(pairs):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: neighbours above a node go to its least neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: of the edges to smaller nodes, all ends go to the least one.
        down = large.where("a > b")
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after, written = stored(small.where("a <> b").distinct())
        discard(spark, folder)
        pairs, folder = after, written
    return pairs, folder


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each larger end ``a`` has one edge down and none up, so that another round would change nothing."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = pairs.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where("up > 1 OR up = 1 AND least = 0").count() == 0
