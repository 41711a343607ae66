"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``); the root is the component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on the
    edge table, cut to a checkpoint after each round, until it is a set of
    stars.  Rounds grow with the logarithm of a component's size; every step
    is a partial minimum and a join on the node, which Spark splits if skewed.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
        # large star: higher neighbours of each node to the least of its neighbourhood
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        stars = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(stars.where("a != b").distinct())
        # small star: lower neighbours of each node, and the node, to the least of them
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        lower = stars.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(lower.union(least).distinct())
