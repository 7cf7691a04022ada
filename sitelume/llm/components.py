"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every node of `edges` (a long, b long) with its component's smallest node.

    Alternates the large-star and small-star steps: each node's neighbours are
    hung on the smallest of them. Every step is one aggregation and one join on
    the node, so a node with very many neighbours is only a skewed join key.
    Returns (node, label); nodes without an edge are not listed.
    """
    now = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # large star: larger neighbours of u go to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = scratch.keep(small)
        changed = after.exceptAll(now).limit(1).count() or after.count() != now.count()
        scratch.drop(now)
        now = after
        if not changed:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
