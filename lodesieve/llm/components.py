"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved, with_labels


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node and root (the smallest of its component) of every node with a link to another.

    A large star links the larger neighbours of each node to the smallest one; a small star links the
    smaller ones. Both keep the components, and after about log(n) rounds all links lead to the roots.
    Each round is written to the shared folder, and what it replaces is deleted; minima combine before the shuffle, also for a hub.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, written = None, [edges]
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, F.least("a", F.min("b"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "links")
        small = with_least(large, F.min("b")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e"))
        edges = saved(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(*written, large)
        written = [edges]
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def with_least(edges: DataFrame, least) -> DataFrame:
    """edges with m, the least of each a's. Nodes of a very high degree, at most 1,000, get theirs by broadcast, so that no hub passes whole through one task."""
    nodes = saved(edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("copies")), "least")
    return with_labels(edges, nodes, "a")
