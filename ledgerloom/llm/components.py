"""Connected components of an edge table by contraction, without moving edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that edges reach from it.

    Every round each root takes the smallest neighbouring root as its parent, chains of parents are
    shortened by joining the parent table with itself, and edges move to the roots; an edge table with no
    edge left ends it. Rounds are logarithmic in the length of a component, and every round is a written
    table, so a lost executor costs one round. Self-loops and repeated edges are allowed; null ends are not.
    """
    edges = scratch.keep(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    labels = scratch.keep(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("comp")))
    live = edges.where("a != b")
    while live.take(1):
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select("b", "a"))
        parent = scratch.keep(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")))
        while True:
            # Grandparents; a parent is never larger than its child, so chains end in roots.
            above = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = scratch.keep(parent.join(above, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
            if not parent.where("moved").take(1):
                break
        roots = parent.select("v", "p")
        labels = scratch.keep(labels.join(roots, labels["comp"] == roots["v"], "left").select("node", F.coalesce("p", "comp").alias("comp")))
        a, b = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        live = scratch.keep(live.join(a, "a").join(b, "b").where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return labels
