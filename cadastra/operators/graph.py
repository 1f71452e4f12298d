"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.storage import stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): every node once, labelled with the least node it reaches.

    Rounds of neighbour minimum and pointer jumping; labels are stored each round,
    so lineage stays flat and rounds grow with the logarithm of the widest component.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct())
    label = stored(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(label.select(F.col("node").alias("to"), "component"), "to").groupBy("node").agg(F.min("component").alias("near"))
        low = label.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("low"))
        far = label.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = stored(low.join(far, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("was")).alias("moved")))
        label = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return label


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The greedy matching in (a, b) order, by rounds of locally least pairs."""
    left = stored(pairs.select("a", "b").distinct())
    taken = left.limit(0)
    while left.limit(1).count():
        rank = F.struct("a", "b")
        best_a = left.groupBy("a").agg(F.min(rank).alias("m")).select("m.*")
        best_b = left.groupBy("b").agg(F.min(rank).alias("m")).select("m.*")
        new = stored(best_a.join(best_b, ["a", "b"], "left_semi"))
        taken = stored(taken.union(new))
        left = stored(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select("a", "b"))
    return taken
