"""Layers of axis-aligned boxes: spatial joins and overlap measures in plain columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
#: Overlaps below this area (square degrees) are noise: the snap tolerance squared.
SLIVER = 1e-16


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])


def overlaps(p: str = "a", q: str = "b") -> Column:
    """Closed-interval overlap of two boxes."""
    c = F.col
    return (c(f"{p}_xmin") <= c(f"{q}_xmax")) & (c(f"{p}_xmax") >= c(f"{q}_xmin")) & (c(f"{p}_ymin") <= c(f"{q}_ymax")) & (c(f"{p}_ymax") >= c(f"{q}_ymin"))


def _extent(grow: float = 0.0) -> Column:
    return F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) + 2 * grow


def _order(grow: float = 0.0) -> Column:
    """The power of two that an extent reaches at most; null for points."""
    return F.when(_extent(grow) > 0, F.ceil(F.log2(_extent(grow))))


def size_classes(a: DataFrame, b: DataFrame, pad: float = 0.0, cell: float | None = None) -> tuple[float, list[int]]:
    """(least cell, powers of two of it that boxes need): one aggregation to a row for each order of magnitude.

    The least cell is twice the mean extent unless it is given.
    """
    order = lambda df, grow: df.select(_extent(grow).alias("e"), _order(grow).cast("int").alias("order")).where("e is not null").groupBy("order").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("whole"), F.min("e").alias("low"), F.max("e").alias("high"))
    rows = order(a, pad).union(order(b, 0.0)).collect()
    many, whole = sum(r.n for r in rows), sum(r.whole for r in rows)
    least = cell or (2 * whole / many if many and whole else 1.0)

    def power(extent: float) -> int:
        k = max(0, math.ceil(math.log2(extent / least)))
        return k if extent <= least * 2.0**k else k + 1

    return least, sorted({power(e) for r in rows if r.order is not None for e in (r.low, r.high)} | {0})


def box_join(a: DataFrame, b: DataFrame, *, pad: float = 0.0, cell: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes (a's padded) meet, with a_ and b_ columns.

    Boxes belong to size classes, each with a grid whose cells are as large as
    its boxes, so a box meets four cells at most however wide it is. Both sides
    are dealt to the cells of their own class and of the larger ones and joined
    on class and cell, an equi-join that shuffles and splits skew as any other.
    In the cells of a class either a is of the class, or b is and a is smaller:
    the two cases have keys of their own, so small boxes don't meet each other
    again in the cells of large ones. A pair counts only in the cell of the
    least corner of its intersection, so no deduplication follows.
    """
    least, classes = size_classes(a, b, pad, cell)
    sizes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(least * 2.0**k).alias("size")) for k in classes])

    def dealt(df: DataFrame, p: str, grow: float) -> DataFrame:
        fits = F.filter(sizes, lambda c: c["size"] >= _extent(grow))
        own = F.transform(fits, lambda c, i: F.struct(c["k"].alias("k"), c["size"].alias("size"), (i == 0).alias("own")))
        df = df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.explode(own).alias("_c"))
        if p == "a":
            smaller = F.array(F.when(F.col("_c.own"), 0).otherwise(1))
        else:
            smaller = F.when(F.col("_c.own") & (F.col("_c.k") > classes[0]), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        low = [F.floor((F.col(f"{p}_{c}") - grow) / F.col("_c.size")).alias(f"{p}_c{c[0]}") for c in ("xmin", "ymin")]
        high = [F.floor((F.col(f"{p}_{c}") + grow) / F.col("_c.size")).alias(f"_{c[0]}") for c in ("xmax", "ymax")]
        df = df.withColumn("_s", F.explode(smaller)).select("*", *low, *high).withColumn("level", F.col("_c.k") * 2 + F.col("_s"))
        return df.withColumn("cx", F.explode(F.sequence(f"{p}_cx", "_x"))).withColumn("cy", F.explode(F.sequence(f"{p}_cy", "_y"))).drop("_c", "_s", "_x", "_y")

    c = F.col
    near = (c("a_xmin") - pad <= c("b_xmax")) & (c("a_xmax") + pad >= c("b_xmin")) & (c("a_ymin") - pad <= c("b_ymax")) & (c("a_ymax") + pad >= c("b_ymin"))
    home = (c("cx") == F.greatest("a_cx", "b_cx")) & (c("cy") == F.greatest("a_cy", "b_cy"))
    pairs = dealt(a, "a", pad).join(dealt(b, "b", 0.0).hint("merge"), ["level", "cx", "cy"])  # never broadcast by the size of compressed files
    return pairs.where(home & near).drop("level", "cx", "cy", "a_cx", "a_cy", "b_cx", "b_cy")


def judged(pairs: DataFrame, name: str, value: Column) -> DataFrame:
    """pairs with a column of the kernel, evaluated once for each pair that is left.

    A filter on a plain column would move into the join, before its own
    conditions: the kernel would see a pair in every cell and in both orders.
    Likewise it would move below the exchange that deals rows out to all tasks.
    """
    return pairs.withColumn(name, F.explode(F.array(value)))


def area(p: str) -> Column:
    return (F.col(f"{p}_xmax") - F.col(f"{p}_xmin")) * (F.col(f"{p}_ymax") - F.col(f"{p}_ymin"))


def intersection() -> list[Column]:
    return [F.greatest("a_xmin", "b_xmin").alias("xmin"), F.greatest("a_ymin", "b_ymin").alias("ymin"), F.least("a_xmax", "b_xmax").alias("xmax"), F.least("a_ymax", "b_ymax").alias("ymax")]


def overlap_pairs(a: DataFrame, b: DataFrame, *, cell: float | None = None) -> DataFrame:
    """(a_fid, b_fid, shared_area, coverage_a, coverage_b, iou) of every overlapping pair above the sliver area."""
    pairs = box_join(a.select("fid", *BOX), b.select("fid", *BOX), cell=cell).select("a_fid", "b_fid", area("a").alias("area_a"), area("b").alias("area_b"), *intersection())
    shared = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    pairs = pairs.withColumn("shared_area", shared).where(F.col("shared_area") >= SLIVER)
    part = lambda whole: F.col("shared_area") / F.nullif(whole, F.lit(0.0))
    return pairs.select("a_fid", "b_fid", "shared_area", part(F.col("area_a")).alias("coverage_a"), part(F.col("area_b")).alias("coverage_b"), part(F.col("area_a") + F.col("area_b") - F.col("shared_area")).alias("iou"))


def nearest(points: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """(a_fid, b_fid, distance) of the nearest target centre within limit of each point's centre; ties to the lowest fid."""
    centre = lambda df: df.select("fid", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y")).select("fid", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    pairs = box_join(centre(points), centre(targets), pad=limit, cell=limit)
    square = F.pow(F.col("a_xmin") - F.col("b_xmin"), F.lit(2)) + F.pow(F.col("a_ymin") - F.col("b_ymin"), F.lit(2))
    pairs = pairs.withColumn("square", square).where(F.col("square") <= limit * limit)
    best = pairs.groupBy("a_fid").agg(F.min(F.struct("square", "b_fid")).alias("m"))
    return best.select("a_fid", F.col("m.b_fid").alias("b_fid"), F.sqrt("m.square").alias("distance"))
