"""Connected components of a graph given as a table of links, with nothing but joins and sums on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node it reaches.

    Large-star and small-star steps in turn: each node's neighbours are linked to the least among them, first
    those above the node, then those below it, until no link changes. A node with very many links is a key of
    a minimum and of a join that Spark may split, never a collected list. Each step's links, and the result, are tables in
    the shared folder. Null ends are no links.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        # Large star: every larger neighbour of a node goes to the node's least neighbour.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Staged, so that the rows of a node with very many links can be split in the join.
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = staged(large)
        drop_staged(least)
        # Small star: a node and its smaller neighbours go to the least of them.
        least = staged(mid.groupBy("a").agg(F.min("b").alias("m")))
        small = mid.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = staged(small)
        for t in (mid, least, now):
            drop_staged(t)
        now = after
        fresh = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if fresh == mark:
            break
        mark = fresh
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = staged(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    drop_staged(now)
    return out
