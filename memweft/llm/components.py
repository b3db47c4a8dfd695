"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Each round links every node to the smallest of its neighbours (large star for larger ones, small
    star for smaller ones) and is written to the shared folder, so lineage stays short and a lost
    executor costs a re-read. Minima are pre-aggregated before they are shuffled, so a hub is not
    collected anywhere. Ends when a round changes nothing; only a sum and a count reach the driver.
    """
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(most_rounds):
        # large star: every neighbour that is larger than a node moves to that node's minimum
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself move to the node's minimum
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.where(F.col("u") != F.col("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if last is not None and tuple(now) == tuple(last):
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
