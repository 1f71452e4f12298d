"""Queries of the geometry kernel, over the boxes of the layers as polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, register_geometry
from cadastra.operators import package, polygons
from cadastra.operators.boxes import BOX
from cadastra.plans.views import view, with_views
from cadastra.registry import query


def layer(spark: SparkSession, d: str, name: str, *more: str) -> DataFrame:
    """A derived layer as polygons."""
    register_geometry(spark)
    return view(spark, d, name).select("fid", geo("box", *BOX).alias("geom"), *more, *BOX)


@query("J03_polygon_overlay", with_views("SELECT a.fid AS a_fid, b.fid AS b_fid, round((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)), 6) AS area FROM units_a a JOIN units_b b ON a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"))
def j03(spark, d):
    return polygons.overlap_pairs(layer(spark, d, "units_a"), layer(spark, d, "units_b")).select("a_fid", "b_fid", F.round(geo("area", "geom"), 6).alias("area"))


@query("J17_shared_edges", with_views("SELECT a.fid AS a_fid, b.fid AS b_fid, CAST(10 AS DOUBLE) AS size FROM units_a a JOIN units_a b ON a.fid < b.fid AND ((a.xmax = b.xmin AND a.ymin = b.ymin) OR (b.xmax = a.xmin AND a.ymin = b.ymin) OR (a.ymax = b.ymin AND a.xmin = b.xmin) OR (b.ymax = a.ymin AND a.xmin = b.xmin))"))
def j17(spark, d):
    return polygons.shared_edges(layer(spark, d, "units_a").withColumn("adm1_code", F.col("fid")), ["adm1_code"], [1]).select("a_fid", "b_fid", geo("perimeter", "geom").alias("size"))


@query("A04_union_areas", with_views("SELECT CAST(floor(ymin / 40) AS BIGINT) AS zone, CAST(count(*) * 100 AS DOUBLE) AS area FROM units_a GROUP BY 1"))
def a04(spark, d):
    from cadastra.functions.geometry import union_agg

    zoned = layer(spark, d, "units_a").select(F.floor(F.col("ymin") / 40).alias("zone"), "geom")
    return union_agg(zoned, ["zone"]).select("zone", F.round(geo("area", "geom"), 6).alias("area"))


@query("G01_polygon_gaps")
def g01(spark, d):
    return polygons.gaps(layer(spark, d, "units_a")).drop("geom")


@query("G05_micro_parts", with_views("SELECT fid FROM units_b WHERE least(xmax - xmin, ymax - ymin) <= 6"))
def g05(spark, d):
    return polygons.micro_parts(layer(spark, d, "units_b"), 6.001).select("fid")


@query("G06_merge_micro")
def g06(spark, d):
    return polygons.merge_micro(layer(spark, d, "units_b"), 6.001).select("fid", F.round(geo("area", "geom"), 6).alias("area"))


@query("G13_coverage_clean")
def g13(spark, d):
    return polygons.clean_coverage(layer(spark, d, "units_b")).select("fid", F.round(geo("area", "geom"), 6).alias("area"))


@query("G15_clip", with_views("SELECT fid, round((least(xmax, 197) - greatest(xmin, 13)) * (least(ymax, 333) - greatest(ymin, 7)), 6) AS area FROM units_a WHERE xmin < 197 AND xmax > 13 AND ymin < 333 AND ymax > 7"))
def g15(spark, d):
    units = layer(spark, d, "units_a")
    boundary = spark.range(1).select(geo("from_text", F.lit("POLYGON((13 7,197 7,197 333,13 333,13 7))")).alias("geom"))
    return polygons.clip(units, boundary)[0].select("fid", F.round(geo("area", "geom"), 6).alias("area"))


@query("G36_points", with_views("SELECT fid, round((xmin + xmax) / 2, 1) AS x, round((ymin + ymax) / 2, 1) AS y FROM units_a"))
def g36(spark, d):
    b = polygons.representative_points(layer(spark, d, "units_a").select("fid", "geom")).withColumn("b", geo("bounds", "geom"))
    return b.select("fid", F.round(F.col("b")[0], 1).alias("x"), F.round(F.col("b")[1], 1).alias("y"))


@query("G37_exterior_edges", with_views("SELECT a.fid, 0 AS level, CAST(10 * (4 - count(b.fid)) AS DOUBLE) AS size FROM units_a a LEFT JOIN units_a b ON (abs(a.xmin - b.xmin) = 10 AND a.ymin = b.ymin) OR (abs(a.ymin - b.ymin) = 10 AND a.xmin = b.xmin) GROUP BY a.fid HAVING count(b.fid) < 4"))
def g37(spark, d):
    return polygons.exterior_edges(layer(spark, d, "units_a"), 0).select("fid", "level", F.round(geo("perimeter", "geom"), 6).alias("size"))


_ZONED = "SELECT fid, 'Z' || CAST(floor(ymin / 40) AS BIGINT) AS adm1_code, 'Z' || CAST(floor(ymin / 40) AS BIGINT) || '-' || fid AS adm2_code, xmin, ymin, xmax, ymax FROM units_a"


def _zoned(spark, d):
    zone = F.concat(F.lit("Z"), F.floor(F.col("ymin") / 40).cast("string"))
    return layer(spark, d, "units_a").withColumn("adm1_code", zone).withColumn("adm2_code", F.concat("adm1_code", F.lit("-"), F.col("fid").cast("string")))


@query("G35_package_polygons", with_views(f"SELECT adm1_code, CAST(count(*) * 100 AS DOUBLE) AS area FROM ({_ZONED}) z GROUP BY adm1_code"))
def g35(spark, d):
    return package.level_polygons(_zoned(spark, d), 1, 2).select("adm1_code", F.round(geo("area", "geom"), 6).alias("area"))


@query("G36_package_points", with_views(f"SELECT 1 AS level, count(DISTINCT adm1_code) AS n FROM ({_ZONED}) z UNION ALL SELECT 2, count(*) FROM units_a"))
def g36_levels(spark, d):
    return package.level_points(_zoned(spark, d), [1, 2]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_TOUCH = "((a.xmax = b.xmin AND a.ymin = b.ymin) OR (b.xmax = a.xmin AND a.ymin = b.ymin) OR (a.ymax = b.ymin AND a.xmin = b.xmin) OR (b.ymax = a.ymin AND a.xmin = b.xmin))"


@query("G37_package_lines", with_views(f"""WITH z AS ({_ZONED}), s AS (SELECT a.fid, CASE WHEN a.adm1_code <> b.adm1_code THEN 1 ELSE 2 END AS level, a.fid < b.fid AS once FROM z a JOIN z b ON a.fid <> b.fid AND {_TOUCH}),
    o AS (SELECT z.fid, 4 - count(s.fid) AS sides FROM z LEFT JOIN s ON s.fid = z.fid GROUP BY z.fid)
    SELECT level, count(*) AS n, 10.0 * count(*) AS size FROM s WHERE once GROUP BY level UNION ALL SELECT 0, count(*), 10.0 * sum(sides) FROM o WHERE sides > 0 HAVING count(*) > 0"""))
def g37_levels(spark, d):
    """Lines of each level, the outline of the layer as level 0, and their lengths."""
    lines = package.level_lines(_zoned(spark, d), [1, 2])
    return lines.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geo("perimeter", "geom")), 6).alias("size"))


@query("G33_verify_export")
def g33(spark, d):
    """Invalid units, overlaps and gaps. The gaps are too slow in SQL; a test fills them by flood."""
    return package.verify_export(layer(spark, d, "units_b"))


@query("G08_erosion", with_views("SELECT DISTINCT a.fid FROM units_b a JOIN units_b b ON a.fid > b.fid AND a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"))
def g08(spark, d):
    before = layer(spark, d, "units_b")
    return polygons.eroded(before, polygons.clean_coverage(before))
