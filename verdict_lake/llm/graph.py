"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stored


def stars(edges: DataFrame) -> DataFrame:
    """One round of large star and small star over (a, b): every node's larger, then smaller neighbours move to the least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # now a > b on every row
    lower = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of links (a, b); links between the same nodes may repeat.

    Nodes are longs without nulls. Rounds of stars until nothing changes, about log2 of the longest path of them; no
    neighbourhood is ever gathered in a row, so a node may have any number of links.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        nxt = stored(stars(edges))
        mark = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, nxt)]
        drop(edges)
        edges = nxt
        if mark[0] == mark[1]:
            break
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
