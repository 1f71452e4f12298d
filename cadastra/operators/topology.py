"""Coverage checks over boxes: overlaps, gaps of a grid, micro units, one issue table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.boxes import BOX, box_join
from cadastra.operators.graph import components

METRES_PER_DEGREE = 111_320.0
#: The columns of the issue table; a kind leaves what does not apply null.
ISSUE_COLUMNS = ["key", "kind", "area_deg", "max_width_deg", "area_m2", "max_width_m", "thinness_ratio", "unit_a", "unit_b", *BOX]


def overlap_regions(layer: DataFrame) -> DataFrame:
    """(unit_a, unit_b, box) of pairs whose interiors meet; touching edges are none."""
    pairs = box_join(layer.select("fid", *BOX), layer.select("fid", *BOX)).where("a_fid < b_fid")
    out = pairs.select(F.col("a_fid").alias("unit_a"), F.col("b_fid").alias("unit_b"), F.greatest("a_xmin", "b_xmin").alias("xmin"), F.greatest("a_ymin", "b_ymin").alias("ymin"), F.least("a_xmax", "b_xmax").alias("xmax"), F.least("a_ymax", "b_ymax").alias("ymax"))
    return out.where("xmax > xmin and ymax > ymin")


def grid_gaps(cells: DataFrame, size: float) -> DataFrame:
    """(gap, n_cells, box): components of empty cells, joined by their sides, that do not reach the border.

    cells (cx, cy) are the covered cells of a grid; the extent is theirs. Gaps
    follow from the cells beside covered ones, so the plan grows with the cover,
    not with the square of the extent, but for wholly empty rows of a gap.
    """
    have = cells.select("cx", "cy").distinct()
    side = have.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    # Empty runs of each row between the extent's ends, from consecutive covered cells.
    w = Window.partitionBy("cy").orderBy("cx")
    rows = side.select(F.explode(F.sequence("y0", "y1")).alias("cy"), "x0", "x1")
    ends = rows.select("cy", (F.col("x0") - 1).alias("cx")).union(rows.select("cy", (F.col("x1") + 1).alias("cx")))
    run = have.select("cy", "cx").union(ends).withColumn("next", F.lead("cx").over(w)).where("next > cx + 1").select("cy", (F.col("cx") + 1).alias("a"), (F.col("next") - 1).alias("b"))
    run = run.withColumn("node", F.col("cy") * 1_000_000_000 + F.col("a"))
    up = run.select((F.col("cy") + 1).alias("cy"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("node").alias("node2"))
    edges = run.join(up, "cy").where("a <= b2 and b >= a2").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    of = run.join(components(run.select("node"), edges), "node").crossJoin(F.broadcast(side))  # one row
    border = (F.col("a") == F.col("x0")) | (F.col("b") == F.col("x1")) | (F.col("cy") == F.col("y0")) | (F.col("cy") == F.col("y1"))
    gaps = of.groupBy("component").agg(F.bool_or(border).alias("open"), F.sum(F.col("b") - F.col("a") + 1).alias("n_cells"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("cy").alias("c"), F.max("cy").alias("d"))
    gaps = gaps.where("not open")
    box = [(F.col("a") * size).alias("xmin"), (F.col("c") * size).alias("ymin"), ((F.col("b") + 1) * size).alias("xmax"), ((F.col("d") + 1) * size).alias("ymax")]
    order = F.row_number().over(Window.orderBy("xmin", "ymin", "xmax", "ymax"))  # gaps alone: a report
    return gaps.select("n_cells", *box).withColumn("gap", order.cast("long")).select("gap", "n_cells", *BOX)


def micro_units(layer: DataFrame, width: float) -> DataFrame:
    """Units no wider than width at their widest inscribed circle; the cheap bound 2 area <= width * perimeter first."""
    x, y = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return layer.where((2 * x * y <= width * 2 * (x + y)) & (F.least(x, y) <= width))


def thinness(df: DataFrame) -> DataFrame:
    """df with area_deg, max_width_deg and the Polsby-Popper ratio of its boxes."""
    x, y = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return df.withColumns({"area_deg": x * y, "max_width_deg": F.least(x, y), "thinness_ratio": 4 * F.pi() * x * y / F.nullif(F.pow(2 * (x + y), F.lit(2)), F.lit(0.0))})


def issue_table(**regions: DataFrame) -> DataFrame:
    """Regions of each kind as one table with keys kind-number: overlaps widest first, others narrowest first."""
    parts = []
    for kind, df in regions.items():
        df = thinness(df).withColumn("kind", F.lit(kind.replace("_", "-")))
        for c in ("unit_a", "unit_b"):
            df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("long"))
        first = F.desc("max_width_deg") if kind == "overlap" else F.asc("max_width_deg")
        w = Window.partitionBy("kind").orderBy(first, *BOX, F.asc_nulls_last("unit_a"), F.asc_nulls_last("unit_b"))
        factor = F.greatest(F.cos(F.radians((F.col("ymin") + F.col("ymax")) / 2)), F.lit(0.05)) * METRES_PER_DEGREE
        df = df.withColumns({"key": F.concat("kind", F.lit("-"), F.row_number().over(w).cast("string")), "area_m2": F.col("area_deg") * factor * METRES_PER_DEGREE, "max_width_m": F.col("max_width_deg") * factor})
        parts.append(df.select(*ISSUE_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def severity(kind: str) -> str:
    """Gaps warn; every other kind is an error."""
    return "warn" if kind == "gap" else "error"


def validate_summary(**stages: DataFrame) -> DataFrame:
    """(stage, kind, severity, count): findings of each stage counted by kind; a stage without any is `no issues`."""
    parts = []
    for stage, df in stages.items():
        counted = df.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("count"))
        none = counted.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no issues").alias("kind"), F.lit("ok").alias("severity"), F.lit(0).cast("long").alias("count"))
        parts.append(counted.unionByName(none).select(F.lit(stage).alias("stage"), "kind", "severity", "count"))
    return reduce(DataFrame.unionByName, parts)
