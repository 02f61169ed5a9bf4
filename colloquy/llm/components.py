"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long), component being its least node.

    Every step replaces a node's neighbours by links to the least of them.  Least
    neighbours are aggregated before they are joined back, so a node may have any number
    of links; steps are stored, so lost executors cost one step.  Nulls are no nodes; no
    links give no rows.
    """
    def signature(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = store(links.dropna(subset=["a", "b"]).where("a <> b").select(larger, smaller).distinct(), "links")
    seen = signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(edges)
        now = signature(after)
        if now == seen:
            break
        edges, seen = after, now
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
