"""Connected components of a link table by alternating stars; links never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fwlens.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``(a, b)``; the component is its smallest node.

    Nulls and self-links are ignored; an empty table gives an empty result. Each round is stored in the checkpoint
    folder, so that losing an executor repeats one round at most.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = checkpointed(edges)
    seen = None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.countDistinct("a")).first()
        # a star forest: each node has one link, and nothing changed by a whole round
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
