"""Lookups and reports over layers of boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators.boxes import BOX


def bounds(layer: DataFrame) -> DataFrame:
    """The extent of a layer; nulls if it is empty."""
    return layer.agg(*[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))])


def attributes_at(layer: DataFrame, x: float, y: float) -> DataFrame:
    """(name, value) of the unit of least fid that holds a point, as text."""
    hit = layer.where((F.col("xmin") <= x) & (F.col("xmax") >= x) & (F.col("ymin") <= y) & (F.col("ymax") >= y)).orderBy("fid").limit(1)
    names = [c for c in layer.columns if c not in (*BOX, "geom", "fid")]
    rows = ", ".join(f"'{c}', cast(`{c}` as string)" for c in names)
    return hit.selectExpr(f"stack({len(names)}, {rows}) AS (name, value)")


def flagged_units(layer: DataFrame, findings: DataFrame, levels: dict[int, str]) -> DataFrame:
    """Rows of a layer that any finding names, by either of its codes at the finding's level; each once."""
    pairs = findings.select("level", F.explode(F.array("code_a", "code_b")).alias("flag")).where("flag is not null").distinct()
    parts = [layer.join(pairs.where(F.col("level") == n).select(F.col("flag").alias(column)), column, "left_semi") for n, column in levels.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def write_back(df: DataFrame, mapping: DataFrame, column: str, parent: str) -> DataFrame:
    """df with column replaced through mapping (old, parent, new), matched null-safely; unmapped values stay."""
    m = mapping.select(F.col("old").alias("_o"), F.col("parent").alias("_p"), F.col("new").alias("_n"), F.lit(True).alias("_hit"))
    out = df.join(m, df[column].eqNullSafe(m["_o"]) & df[parent].eqNullSafe(m["_p"]), "left")
    return out.withColumn(column, F.when(F.col("_hit"), F.col("_n")).otherwise(F.col(column))).select(*df.columns)


def carry(inputs: DataFrame, winner: DataFrame, prefix: str = "overlay_") -> DataFrame:
    """The attributes of one winning row on every input row; raises ValueError where names clash."""
    extra = winner.select(*[F.col(c).alias(f"{prefix}{c}") for c in winner.columns if c not in (*BOX, "geom")])
    clash = sorted(set(extra.columns) & set(inputs.columns))
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    return inputs.crossJoin(F.broadcast(extra.limit(1)))  # one row
