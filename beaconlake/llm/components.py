"""Connected components by alternating star steps, with no node's links in one place.

A large-star step links every larger neighbour of a node to the smallest node around it, a small-star
step does so for the smaller ones; a few rounds leave one star per component. Minima are
pre-aggregated, and the minima are stored before they are joined back, so that Spark can split
the partition of a hub. Every step ends in a reliable checkpoint."""
from pyspark.sql import DataFrame, functions as F

from beaconlake.session import checkpointed


def _star(links: DataFrame, near: DataFrame, keep) -> DataFrame:
    """links (a, b), each b joined with the least node around a; `keep` picks the b that move."""
    least = checkpointed(near.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("at"), F.least("a", "low").alias("low")))
    moved = links.where(keep).join(least, F.col("a") == F.col("at"))
    return moved.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _settled(links: DataFrame) -> bool:
    """Whether all links are stars already: a node has one link down, or links up, not both."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    both = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1")
    return not both.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one comparable type. Returns (node, component) for every linked node;
    a component is named by its smallest node. No edges give no rows."""
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, both, F.col("b") > F.col("a")).where("a <> b")
        large = checkpointed(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "at"))
        small = large.join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = least.select(F.col("at").alias("a"), F.col("low").alias("b"))
        links = checkpointed(small.unionByName(own).where("a <> b").distinct())
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
