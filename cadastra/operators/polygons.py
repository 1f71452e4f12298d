"""Polygon layers (fid, geom as WKB): overlay, gaps, clip, dissolve, boundaries, points, repair.

Callers register the geometry kernel first. Spatial joins go by boxes over grid
cells; the kernel decides on the pairs that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.geometry import frame_of, geo, union_agg, united, with_bounds
from cadastra.operators.boxes import BOX, SLIVER, box_join, judged
from cadastra.operators.dissolve import boundary_level, dissolve
from cadastra.operators.graph import components
from cadastra.storage import stored

SNAP = 1e-8
#: The insides of two boxes meet; interiors of polygons meet in none of the others, so the kernel needn't be asked.
MEET = "a_xmin < b_xmax and a_xmax > b_xmin and a_ymin < b_ymax and a_ymax > b_ymin"


def spread(df: DataFrame) -> DataFrame:
    """df over all tasks before the kernel's work: a file of boxes may be a single split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounded(layer: DataFrame) -> DataFrame:
    """Repaired polygons with their boxes; null and empty ones go."""
    df = judged(spread(layer), "geom", geo("fix", "geom")).where(F.col("geom").isNotNull())
    return stored(with_bounds(df.select(*[c for c in df.columns if c not in BOX])))


def check_extent(layer: DataFrame) -> DataFrame:
    """The layer, asserted to lie within longitudes and latitudes."""
    e = layer.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if e[0] is not None and (e[0] < -180 or e[1] < -90 or e[2] > 180 or e[3] > 90):
        raise ValueError(f"extent outside longitudes and latitudes: {tuple(e)}")
    return layer


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_fid, b_fid, geom, shared_area, coverage_a, coverage_b, iou); ratios on an equal-area plane."""
    pairs = box_join(a.select("fid", "geom", *BOX), b.select("fid", "geom", *BOX)).where(geo("overlaps", "a_geom", "b_geom"))
    pairs = pairs.withColumn("geom", geo("intersection", "a_geom", "b_geom")).where(geo("area", "geom") >= SLIVER)
    area = lambda c: geo("area", geo("equal_area", c))
    pairs = pairs.select("a_fid", "b_fid", "geom", area("geom").alias("shared_area"), area("a_geom").alias("x"), area("b_geom").alias("y"))
    share = lambda whole: F.col("shared_area") / F.nullif(whole, F.lit(0.0))
    return pairs.select("a_fid", "b_fid", "geom", "shared_area", share(F.col("x")).alias("coverage_a"), share(F.col("y")).alias("coverage_b"), share(F.col("x") + F.col("y") - F.col("shared_area")).alias("iou"))


def overlap_regions(layer: DataFrame) -> DataFrame:
    """(unit_a, unit_b, geom) of pairs whose interiors meet."""
    one = layer.select("fid", "geom", *BOX)
    pairs = judged(box_join(one, one).where("a_fid < b_fid").where(MEET), "geom", F.when(geo("overlaps", "a_geom", "b_geom"), geo("intersection", "a_geom", "b_geom")))
    return pairs.where("geom is not null").select(F.col("a_fid").alias("unit_a"), F.col("b_fid").alias("unit_b"), "geom")


def clusters(layer: DataFrame) -> DataFrame:
    """(fid, cluster): units joined by touching boxes; no gap spans two clusters' polygons alone."""
    one = layer.select("fid", *BOX)
    edges = box_join(one, one).where("a_fid < b_fid").select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))
    return components(one.select(F.col("fid").alias("node")), edges).select(F.col("node").alias("fid"), F.col("component").alias("cluster"))


def enclosed(layer: DataFrame, fan: int = 64) -> DataFrame:
    """(geom): holes of the union of the layer that no polygon lies in.

    The union goes in a tree along a Hilbert curve. A hole of a piece that meets
    no outline of another piece is a hole of the whole union: it leaves the tree
    and is filled, so the last unions see outlines, not all holes of the layer.
    """
    pieces, found = stored(layer.select("geom").where("geom is not null")), []
    frame, n = frame_of(pieces)
    while n > fan and frame:
        pieces = stored(united(pieces, [], frame, n, fan=fan).withColumnRenamed("_part", "id"))
        n = pieces.count()
        if n > fan:
            holes = stored(with_bounds(pieces.select("id", F.explode(geo("apart", "geom")).alias("geom"))))
            shells = stored(with_bounds(pieces.select("id", F.explode(geo("shells", "geom")).alias("geom"))))
            entered = judged(box_join(holes, shells).where("a_id <> b_id").where(MEET), "meet", geo("overlaps", "a_geom", "b_geom")).where("meet")
            closed = stored(holes.select("id", "geom").join(entered.select(F.col("a_id").alias("id"), F.col("a_geom").alias("geom")).distinct(), ["id", "geom"], "left_anti"))
            found.append(closed.select("geom"))
            pieces = stored(pieces.join(closed.groupBy("id").agg(F.collect_list("geom").alias("g")), "id", "left").select(geo("without", "geom", "g").alias("geom")))
    last = pieces.agg(F.collect_list("geom").alias("g")).select(F.explode(geo("gaps", geo("union_all", "g"))).alias("geom"))
    return reduce(DataFrame.union, found, last)


def gaps(layer: DataFrame) -> DataFrame:
    """(gap, geom, width): holes of the union of the layer, numbered by their boxes. Stored: each is measured once."""
    holes = enclosed(layer).withColumn("_at", F.xxhash64("geom")).repartition(int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_at").drop("_at")  # the last ones come out of one row
    holes = stored(with_bounds(holes.withColumn("width", geo("width", "geom"))))
    order = Window.orderBy(*BOX, F.sha2("geom", 256))  # gaps alone: a report
    return stored(holes.select(F.row_number().over(order).cast("long").alias("gap"), "geom", "width", *BOX))


def micro_parts(layer: DataFrame, width: float) -> DataFrame:
    """(fid, part, geom) of polygons no wider than width; the bound 2 area <= width * perimeter guards the circle."""
    parts = layer.select("fid", F.posexplode(geo("parts", "geom")).alias("part", "geom"))
    thin = 2 * geo("area", "geom") <= F.lit(width) * geo("perimeter", "geom")
    return parts.where(F.when(thin, geo("width", "geom") <= width).otherwise(False))


def merge_micro(layer: DataFrame, width: float, tolerance: float = SNAP) -> DataFrame:
    """The layer with each micro part moved to the unit that shares most of its buffered outline (ties to the lowest fid), or dropped without one; units left without parts vanish."""
    parts = stored(layer.select("fid", F.posexplode(geo("parts", "geom")).alias("part", "geom")))
    thin = 2 * geo("area", "geom") <= F.lit(width) * geo("perimeter", "geom")
    marked = stored(with_bounds(parts.withColumn("micro", F.when(thin, geo("width", "geom") <= width).otherwise(False))))
    if marked.where("micro").isEmpty():
        return layer.select("fid", "geom")
    small = marked.where("micro").withColumn("key", F.xxhash64("fid", "part"))
    big = marked.where("not micro")
    near = box_join(small.select("key", "geom", *BOX), big.select("fid", "geom", *BOX), pad=tolerance)
    near = judged(near, "weight", geo("area", geo("intersection", geo("buffer", "a_geom", F.lit(tolerance)), "b_geom"))).where("weight > 0")
    best = near.groupBy(F.col("a_key").alias("key")).agg(F.max(F.struct("weight", (-F.col("b_fid")).alias("back"))).alias("m")).select("key", (-F.col("m.back")).alias("to"))
    moved = small.join(best, "key").select(F.col("to").alias("fid"), "geom")
    touched = moved.select("fid").union(small.select("fid")).distinct()
    again = big.join(touched, "fid", "left_semi").select("fid", "geom").union(moved)
    rebuilt = union_agg(again, ["fid"])
    return layer.select("fid", "geom").join(touched, "fid", "left_anti").union(rebuilt)


def subdivide(boundary: DataFrame, vertices: int = 1350) -> DataFrame:
    """(tile, geom) of one polygon cut by cells sized for so many vertices each; empty cells go."""
    b = with_bounds(boundary.select("geom")).withColumn("points", geo("points", "geom"))
    cell = F.least(F.greatest(F.sqrt(F.lit(float(vertices)) * (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / F.col("points")), F.lit(0.05)), F.lit(5.0))
    b = b.withColumn("cell", F.when(F.col("points") < 5000, F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) + 1).otherwise(cell))
    b = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("xmax") - F.col("xmin")) / F.col("cell")).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), F.floor((F.col("ymax") - F.col("ymin")) / F.col("cell")).cast("int"))))
    x, y, c = F.col("xmin") + F.col("i") * F.col("cell"), F.col("ymin") + F.col("j") * F.col("cell"), F.col("cell")
    text = F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))", x, y, x + c, y, x + c, y + c, x, y + c, x, y)
    return b.select(F.concat_ws("-", "i", "j").alias("tile"), geo("intersection", "geom", geo("from_text", text)).alias("geom")).where("geom is not null")


def clip(layer: DataFrame, boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clipped layer, issues): rows cut to the boundary by its tiles; rows that end empty are clip-empty issues."""
    tiles = with_bounds(subdivide(boundary)).withColumn("fid", F.xxhash64("tile"))
    pieces = box_join(layer.select("fid", "geom", *BOX), tiles.select("fid", "geom", *BOX)).select(F.col("a_fid").alias("fid"), geo("intersection", "a_geom", "b_geom").alias("geom")).where("geom is not null")
    out = stored(union_agg(pieces, ["fid"]))
    return out, layer.select("fid").join(out.select("fid"), "fid", "left_anti").select(F.lit("clip-empty").alias("kind"), "fid")


def dissolve_polygons(layer: DataFrame, group_by: list[str], **options) -> DataFrame:
    """Attributes by the dissolve policy, and the union of the geometries of each group."""
    flat = dissolve(layer.drop("geom", *BOX), group_by, **options)
    shapes = union_agg(layer.select(*group_by, "geom"), group_by).withColumnsRenamed({k: f"_s_{k}" for k in group_by})
    on = [flat[k].eqNullSafe(shapes[f"_s_{k}"]) for k in group_by]
    return flat.join(shapes, on).drop(*[f"_s_{k}" for k in group_by])


def representative_points(layer: DataFrame) -> DataFrame:
    """One point a unit: the centre of its largest inscribed circle."""
    return layer.withColumn("geom", geo("centre", "geom"))


def shared_edges(layer: DataFrame, codes: list[str], levels: list[int]) -> DataFrame:
    """(a_fid, b_fid, level, geom): lines that two units share, at the first level at which their codes differ."""
    one = layer.select("fid", "geom", *codes, *BOX)
    pairs = box_join(one, one).where("a_fid < b_fid").withColumn("geom", geo("shared_line", "a_geom", "b_geom")).where("geom is not null")
    return boundary_level(pairs, levels).select("a_fid", "b_fid", "level", "geom")


def exterior_edges(layer: DataFrame, level: int) -> DataFrame:
    """(fid, level, geom): outlines less those of the units whose boxes meet."""
    one = layer.select("fid", geo("boundary", "geom").alias("geom"), *BOX)
    near = box_join(one, one).where("a_fid <> b_fid").groupBy("a_fid").agg(F.collect_list("b_geom").alias("g"))  # neighbours of one unit
    rest = one.join(near.select(F.col("a_fid").alias("fid"), geo("union_all", "g").alias("others")), "fid", "left")
    return rest.select("fid", F.lit(level).alias("level"), geo("merge_lines", geo("difference", "geom", "others")).alias("geom")).where("geom is not null")


def eroded(before: DataFrame, after: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """fids whose polygon after, grown by the tolerance, does not cover the one before."""
    both = before.select("fid", F.col("geom").alias("old")).join(after.select("fid", F.col("geom").alias("new")), "fid", "left")
    return both.where(~F.coalesce(geo("covers", geo("buffer", "new", F.lit(tolerance)), "old"), F.lit(False))).select("fid")


def check_no_erosion(before: DataFrame, after: DataFrame, tolerance: float = SNAP) -> None:
    lost = [r.fid for r in eroded(before, after, tolerance).orderBy("fid").limit(20).collect()]
    if lost:
        raise ValueError(f"units lost area: {', '.join(map(str, lost))}")


def clean_coverage(layer: DataFrame, gap_width: float = 0.0, grid: float = SNAP) -> DataFrame:
    """(fid, geom) without overlaps, and without gaps up to gap_width.

    Vertices go to a grid; an overlap stays with the lower fid; a gap goes to the
    neighbour with the longest shared line (ties to the lowest fid). Units that
    collapse keep their original shape.
    """
    base = stored(with_bounds(judged(spread(layer.select("fid", "geom")), "geom", geo("on_grid", "geom", F.lit(grid))).where("geom is not null")))
    pairs = judged(box_join(base.select("fid", "geom", *BOX), base.select("fid", "geom", *BOX)).where("a_fid > b_fid").where(MEET), "meet", geo("overlaps", "a_geom", "b_geom")).where("meet")
    taken = pairs.groupBy(F.col("a_fid").alias("fid")).agg(F.collect_list("b_geom").alias("g")).select("fid", geo("union_all", "g").alias("taken"))  # neighbours of one unit
    cut = base.join(taken, "fid", "left").select("fid", geo("difference", "geom", "taken").alias("cut"), "geom")
    flat = stored(with_bounds(cut.select("fid", F.coalesce("cut", "geom").alias("geom"))))
    if gap_width > 0:
        holes = gaps(flat).where(F.col("width") <= gap_width).withColumnRenamed("gap", "key")
        near = box_join(holes.select("key", "geom", *BOX), flat.select("fid", "geom", *BOX)).withColumn("line", geo("shared_line", "a_geom", "b_geom"))
        near = near.where("line is not null").withColumn("size", geo("perimeter", "line"))
        best = near.groupBy("a_key").agg(F.max(F.struct("size", (-F.col("b_fid")).alias("back"), "a_geom")).alias("m")).select((-F.col("m.back")).alias("fid"), F.col("m.a_geom").alias("geom"))
        flat = union_agg(flat.select("fid", "geom").union(best), ["fid"])
    return flat.select("fid", "geom")


def stitch(layer: DataFrame, gap_width: float = 0.0, steps: int = 9) -> DataFrame:
    """clean_coverage on ever coarser grids until no overlap is left, steps at most; raises ValueError if one is."""
    for k in range(1, steps + 1):
        out = stored(with_bounds(clean_coverage(layer, gap_width, SNAP * k)))
        left = overlap_regions(out).where(geo("area", "geom") >= SLIVER).limit(1).count()
        if not left:
            return out.select("fid", "geom")
    raise ValueError(f"overlaps are left after {steps} grids")
