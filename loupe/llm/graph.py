"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loupe.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large-star and small-star steps in turn hang every node below the smallest
    one it can see, until a round changes nothing.  Neighbours are reduced by
    aggregates before they are shuffled and never gathered; each round is
    written to the shared folder, so no lineage builds up.  Both ends are
    whole numbers; loops and repeated edges do no harm, and no edges give no
    rows.
    """
    star = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before != (now := tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())):
        before = now
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
