"""Connected components of a table of links, by alternating stars (Kiveris and others, 2014)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.session import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every `a` has one `b` and no `b` is an `a`: the links are stars around their roots."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return seen.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots; the root is the smallest node of its component.

    A node's neighbours are never gathered: their minimum is a grouped aggregate, joined back to the links. Each round is
    written out. Loops are ignored; no links give no rows. Rounds go on until all links lead to roots, about log(nodes) of them.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    while not _settled(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
