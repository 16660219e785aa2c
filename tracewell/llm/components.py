"""Connected components of a table of links, in rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of links (a, b) reaches.

    Each round hangs every node below its smallest neighbour, follows the pointers
    twice, and keeps the links between different labels; their number falls at least
    by half, and nothing but a row count comes to the driver. Links are summed up
    before they are dealt out, so a node with very many links is no hot key.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        up = written(up)
        for _ in range(2):
            top = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = up.join(top, "p").select("v", F.col("q").alias("p"))
        up = written(up)
        if labels is None:
            labels = up.select(F.col("v").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(up, F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label"))
            labels = written(moved)
        left = edges.join(up.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = written(left.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
