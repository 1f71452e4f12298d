"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm._io import Scratch


def connected_components(edges: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """(id, component) for every endpoint of edges (a, b); component is the least id reachable.

    Each round takes the least label of the neighbours, then follows it once
    (pointer jumping), so rounds grow with the logarithm of a component's width.
    Labels are tables in the shared folder; only the count of changed labels
    comes to the driver. A node of many edges costs one partial minimum.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
    both = tmp.save(both.distinct(), f"{name}-edges")
    label = tmp.save(both.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("near"))
        low = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = low.join(jump, "low").select("id", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("was")).alias("moved"))
        new = tmp.save(new, f"{name}-{step}")
        done = new.where("moved").limit(1).count() == 0
        tmp.drop(f"{name}-{step - 1}")
        label = new.drop("moved")
        if done:
            tmp.drop(f"{name}-edges")
            return label
