"""Queries of whole topology runs, over the layers as polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, register_geometry
from cadastra.operators import assign, boxes, polygons, workflows
from cadastra.plans.polygon_queries import layer
from cadastra.plans.views import view, with_views
from cadastra.registry import query
from cadastra.storage import stored

#: units_b as diamonds (rings that are no boxes): half the area, touching at their corners.
_DIAMOND = "(ymax - ymin) * (xmax - xmin) / 2"


def diamonds(spark, d, name="units_b"):
    register_geometry(spark)
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    text = F.format_string("POLYGON((%s %s,%s %s,%s %s,%s %s,%s %s))", x, "ymin", "xmax", y, x, "ymax", "xmin", y, x, "ymin")
    return view(spark, d, name).select("fid", geo("from_text", text).alias("geom"), *boxes.BOX)


def _area():
    return F.round(geo("area", "geom"), 6).alias("area")


@query("G02_gaps_in_targets")
def g02(spark, d):
    zones = layer(spark, d, "overlay")
    return workflows.in_targets(polygons.gaps(layer(spark, d, "units_a")), zones).select("gap", F.round("width", 6).alias("width"), *boxes.BOX)


@query("G03_has_gap", with_views("SELECT count(*) > 0 AS any_gap, false AS narrow_gap FROM part WHERE p_partkey % 31 = 2"))
def g03(spark, d):
    units = layer(spark, d, "units_a")
    found = polygons.gaps(units)
    return spark.createDataFrame([(workflows.has_gap(units, found=found), workflows.has_gap(units, 0.5, found))], "any_gap boolean, narrow_gap boolean")


@query("G12_diamond_overlaps", with_views(f"SELECT fid, round({_DIAMOND}, 6) AS area FROM units_b"))
def g12_diamonds(spark, d):
    return diamonds(spark, d).select("fid", _area())


@query("G34_detect", with_views("SELECT 'overlap' AS kind, 'error' AS severity, count(*) AS n FROM units_b a JOIN units_b b ON a.fid < b.fid AND a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin UNION ALL SELECT 'micro-polygon', 'error', count(*) FROM units_b WHERE least(xmax - xmin, ymax - ymin) <= 6"))
def g34(spark, d):
    """Overlaps and micro polygons of the issue table (its gaps are tested by flood)."""
    found, failed = workflows.detect(layer(spark, d, "units_b"), 6.001)
    assert not failed, failed
    return found.where("kind <> 'gap'").groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("G29_topo_clean")
def g29(spark, d):
    """The cleaned layer; a clean that is not accepted is an error, as its layer is the input."""
    out = workflows.topo_clean(layer(spark, d, "units_b"))
    if refused := out["checks"].where("not ok").collect():
        raise ValueError(f"the clean is not accepted: {', '.join(f'{r.check} ({r.detail})' for r in refused)}")
    return out["layer"].select("fid", _area())


@query("G32_acceptance", with_views("SELECT * FROM (VALUES ('overlaps', true), ('area', true), ('units', true), ('polygons', true), ('gaps', true)) t(\"check\", ok)"))
def g32(spark, d):
    before = layer(spark, d, "units_b")
    return workflows.acceptance(before, polygons.clean_coverage(before), 0.0).select("check", "ok")


@query("G31_fixed_issues", with_views("SELECT 'overlap' AS kind, true AS fixed, count(*) AS n FROM units_b a JOIN units_b b ON a.fid < b.fid AND a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"))
def g31(spark, d):
    before = workflows.Scanned(layer(spark, d, "units_b"))
    found = workflows.issues(workflows.complete(before))
    after = polygons.clean_coverage(before.layer)
    return workflows.fixed_issues(stored(found), before, after).where("kind = 'overlap'").groupBy("kind", "fixed").agg(F.count(F.lit(1)).alias("n"))


_FRAME = "POLYGON((13 7,197 7,197 333,13 333,13 7))"
_CUT = "SELECT fid, round((least(xmax, 197) - greatest(xmin, 13)) * (least(ymax, 333) - greatest(ymin, 7)), 6) AS area FROM units_a WHERE xmin < 197 AND xmax > 13 AND ymin < 333 AND ymax > 7"


def _boundary(spark):
    return spark.range(1).select(geo("from_text", F.lit(_FRAME)).alias("geom"))


@query("G26_clip_issues", with_views("SELECT 'clip-empty' AS kind, fid FROM units_a WHERE NOT (xmin < 197 AND xmax > 13 AND ymin < 333 AND ymax > 7)"))
def g26(spark, d):
    units = layer(spark, d, "units_a")
    return workflows.clip_run(units, _boundary(spark))[1]


@query("G07_detached_pieces")
def g07(spark, d):
    """Strips of the layer cut by a comb: the pieces of a strip beyond its largest one, by outcome (a test has each outcome)."""
    from cadastra.functions.geometry import union_agg
    from cadastra.operators.detached import outcomes

    strips = union_agg(_zones(spark, d).select(F.col("group").alias("fid"), "geom"), ["fid"])
    teeth = spark.range(0, 400, 20).select(geo("from_text", F.format_string("POLYGON((%s -1,%s -1,%s 9999,%s 9999,%s -1))", "id", F.col("id") + 13, F.col("id") + 13, "id", "id")).alias("geom"))
    comb = union_agg(teeth, [])
    cut, _ = polygons.clip(polygons.bounded(strips), comb)
    found = outcomes(cut, strips, comb, strips)
    return found.groupBy("fid", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("area"))


@query("G28_mosaic", with_views(_CUT))
def g28(spark, d):
    units = layer(spark, d, "units_a")
    return workflows.mosaic(units, _boundary(spark))[0].select("fid", _area())


@query("G40_validation", with_views("SELECT 'overlaps' AS \"check\", true AS ok, '0' AS detail UNION ALL SELECT 'micro parts', true, '0' UNION ALL SELECT 'rows', true, '0'"))
def g40(spark, d):
    units = layer(spark, d, "units_a")
    return workflows.validation(units, units).where("check <> 'gaps'")


def _zones(spark, d):
    """units_a by strips of four rows of the grid."""
    return layer(spark, d, "units_a").withColumn("group", F.floor(F.col("ymin") / 40))


_STRIPS = "SELECT CAST(floor(ymin / 40) AS BIGINT) AS strip, min(xmin) - 5 AS a, min(ymin) - 5 AS b, max(xmax) + 5 AS c, max(ymax) + 5 AS d, count(*) AS n FROM units_a GROUP BY 1"


@query("G23_extend", with_views(f"SELECT strip, n, round((c - a) * (d - b), 3) AS area FROM ({_STRIPS}) s"))
def g23(spark, d):
    """Units grown to fill a frame five degrees beyond their strip: the areas sum to the frame's."""
    units = _zones(spark, d)
    grown, failed = workflows.extend(units, workflows.frame(units, 5.0, F.col("group")))
    return grown.groupBy(F.col("group").alias("strip")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geo("area", "geom")), 3).alias("area"))


@query("G19_edge_distance", with_views("SELECT least(2e-4, 10.0) AS distance FROM units_a LIMIT 1"))
def g19(spark, d):
    lines = polygons.exterior_edges(layer(spark, d, "units_a"), 0)
    return spark.createDataFrame([(workflows.edge_distance(lines),)], "distance double")


def _assigned(spark, d):
    units, zones = view(spark, d, "units_a"), view(spark, d, "overlay")
    best = assign.best_overlap(boxes.overlap_pairs(units, zones)).select(F.col("input_fid").alias("fid"), "overlay_fid")
    return units.select("fid").join(best, "fid", "left")


_BEST = "SELECT a.fid, arg_max(o.fid, ((least(a.xmax, o.xmax) - greatest(a.xmin, o.xmin)) * (least(a.ymax, o.ymax) - greatest(a.ymin, o.ymin)), -o.fid)) AS overlay_fid FROM units_a a JOIN overlay o ON a.xmin < o.xmax AND a.xmax > o.xmin AND a.ymin < o.ymax AND a.ymax > o.ymin GROUP BY a.fid"


@query("G42_list_groups", with_views(f"WITH b AS ({_BEST}), c AS (SELECT coalesce(overlay_fid, -1) AS grp, count(*) AS n FROM units_a u LEFT JOIN b ON b.fid = u.fid GROUP BY 1) SELECT grp AS \"group\", o.name AS label, n, row_number() OVER (ORDER BY grp = -1, grp) AS place FROM c LEFT JOIN overlay o ON o.fid = c.grp"))
def g42(spark, d):
    return workflows.list_groups(_assigned(spark, d), view(spark, d, "overlay"), "name")


@query("G24_edge_match", with_views(f"WITH b AS ({_BEST}) SELECT overlay_fid, count(*) AS n, round(any_value((o.xmax - o.xmin) * (o.ymax - o.ymin)), 3) AS area FROM b JOIN overlay o ON o.fid = b.overlay_fid GROUP BY overlay_fid"))
def g24(spark, d):
    """The units of a target fill it: their areas sum to its area."""
    out, _ = workflows.edge_match(layer(spark, d, "units_a"), layer(spark, d, "overlay"), _assigned(spark, d))
    return out.groupBy("overlay_fid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geo("area", "geom")), 3).alias("area"))


@query("G25_match_issues", with_views(f"WITH b AS ({_BEST}) SELECT 'unassigned' AS kind, fid FROM units_a WHERE fid NOT IN (SELECT fid FROM b)"))
def g25(spark, d):
    return workflows.edge_match(layer(spark, d, "units_a"), layer(spark, d, "overlay"), _assigned(spark, d))[1]
