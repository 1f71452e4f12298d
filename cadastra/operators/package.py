"""Packaging of a hierarchy: polygons, points and lines of every level."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, with_bounds
from cadastra.operators import polygons
from cadastra.operators.boxes import BOX, SLIVER
from cadastra.operators.topology import METRES_PER_DEGREE


def level_polygons(layer: DataFrame, level: int, finest: int, template: str = "adm{n}_code") -> DataFrame:
    """The units of one level: the layer itself at the finest, else its dissolve by the codes down to that level."""
    if level == finest:
        return layer
    keys = [template.format(n=n) for n in range(1, level + 1) if template.format(n=n) in layer.columns]
    return polygons.dissolve_polygons(layer, keys, exclude=["fid"])


def level_points(layer: DataFrame, levels: list[int], template: str = "adm{n}_code") -> DataFrame:
    """One point a unit of each level, in a column level; columns that a level lacks are null."""
    finest, out = max(levels), None
    for n in sorted(levels):
        part = polygons.representative_points(level_polygons(layer, n, finest, template).drop(*BOX)).withColumn("level", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def level_lines(layer: DataFrame, levels: list[int], template: str = "adm{n}_code") -> DataFrame:
    """(a_fid, b_fid, level, geom): shared edges at the first level that differs; outlines one level above the first, without a second unit."""
    codes = [template.format(n=n) for n in sorted(levels)]
    inner = polygons.shared_edges(layer, codes, levels)
    outer = polygons.exterior_edges(layer, min(levels) - 1).select(F.col("fid").alias("a_fid"), F.lit(None).cast("long").alias("b_fid"), "level", "geom")
    return inner.unionByName(outer)


def check_lines(layer: DataFrame, lines: DataFrame) -> None:
    """Raise ValueError unless every unit has a boundary row."""
    seen = lines.select(F.col("a_fid").alias("fid")).union(lines.select("b_fid"))
    lost = [r.fid for r in layer.select("fid").join(seen, "fid", "left_anti").orderBy("fid").limit(20).collect()]
    if lost:
        raise ValueError(f"units without a boundary: {', '.join(map(str, lost))}")


def run_package(layer: DataFrame, levels: list[int], template: str = "adm{n}_code") -> dict[str, DataFrame]:
    """All outputs of a layer: polygons_<n>, points, lines."""
    layer = polygons.bounded(layer)
    lines = level_lines(layer, levels, template)
    check_lines(layer, lines)
    return {**{f"polygons_{n}": level_polygons(layer, n, max(levels), template) for n in levels}, "points": level_points(layer, levels, template), "lines": lines}


def verify_export(layer: DataFrame, gap_width: float = math.inf) -> DataFrame:
    """(kind, n): invalid polygons, overlaps above the sliver area, and gaps up to a width, counted anew on an output."""
    layer = layer if set(BOX) <= set(layer.columns) else with_bounds(layer)
    parts = [
        layer.agg(F.count_if(~geo("valid", "geom")).alias("n")).select(F.lit("invalid").alias("kind"), "n"),
        polygons.overlap_regions(layer).where(geo("area", "geom") >= SLIVER).agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlap"), "n"),
        polygons.gaps(layer).where(F.col("width") <= gap_width).agg(F.count(F.lit(1)).alias("n")).select(F.lit("gap"), "n"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def fill_width(gaps: DataFrame, mode: str, manual: float = 0.0, thin: float = 0.3) -> float:
    """The gap width to fill, in degrees: none (0), thin (the widest gap of a low Polsby-Popper ratio), all (360) or manual."""
    if mode == "none":
        return 0.0
    if mode == "all":
        return 360.0
    if mode == "manual":
        return manual
    if mode != "thin":
        raise ValueError(f"unknown mode {mode}")
    ratio = 4 * math.pi * geo("area", "geom") / F.nullif(F.pow(geo("perimeter", "geom"), F.lit(2)), F.lit(0.0))
    widest = gaps.where(ratio < thin).agg(F.max("width")).first()[0]
    return (widest or 0.0) * 1.01


def metres_to_degrees(metres: float, latitude: float) -> float:
    """Metres as degrees at a latitude; the cosine has a floor near the poles."""
    return metres / (METRES_PER_DEGREE * max(math.cos(math.radians(latitude)), 0.05))
