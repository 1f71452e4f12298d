"""Queries over coverages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import codes, dissolve, hierarchy, names, polygons, topology
from cadastra.plans.polygon_queries import layer
from cadastra.plans.views import view, with_views
from cadastra.registry import query

_CELLS = "SELECT DISTINCT CAST(floor(xmin / 10) AS BIGINT) AS cx, CAST(floor(ymin / 10) AS BIGINT) AS cy FROM units_a"


def _cells(spark, d):
    return view(spark, d, "units_a").select(F.floor(F.col("xmin") / 10).alias("cx"), F.floor(F.col("ymin") / 10).alias("cy"))


@query("G01_grid_gaps", with_views(f"""WITH RECURSIVE c AS ({_CELLS}), s AS (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM c),
    e AS (SELECT x AS cx, y AS cy, x = x0 OR x = x1 OR y = y0 OR y = y1 AS border FROM s, unnest(generate_series(x0, x1)) AS t(x), unnest(generate_series(y0, y1)) AS u(y) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.cx = x AND c.cy = y)),
    r(cx, cy, root) AS (SELECT cx, cy, cy * 1000000 + cx FROM e UNION SELECT e.cx, e.cy, r.root FROM r JOIN e ON abs(e.cx - r.cx) + abs(e.cy - r.cy) = 1),
    g AS (SELECT cx, cy, min(root) AS root FROM r GROUP BY cx, cy)
    SELECT count(*) AS n_cells, CAST(min(g.cx) * 10 AS DOUBLE) AS xmin, CAST(min(g.cy) * 10 AS DOUBLE) AS ymin, CAST(max(g.cx) * 10 + 10 AS DOUBLE) AS xmax, CAST(max(g.cy) * 10 + 10 AS DOUBLE) AS ymax FROM g JOIN e ON e.cx = g.cx AND e.cy = g.cy GROUP BY root HAVING NOT bool_or(border)"""))
def g01(spark, d):
    return topology.grid_gaps(_cells(spark, d), 10.0).drop("gap")


_OVERLAPS = "SELECT a.fid AS unit_a, b.fid AS unit_b, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax FROM units_b a JOIN units_b b ON a.fid < b.fid AND a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"


@query("G04_overlap_regions", with_views(_OVERLAPS))
def g04(spark, d):
    return topology.overlap_regions(view(spark, d, "units_b"))


@query("G05_micro_units", with_views("SELECT fid FROM units_b WHERE least(xmax - xmin, ymax - ymin) <= 6 AND 2 * (xmax - xmin) * (ymax - ymin) <= 6 * 2 * (xmax - xmin + ymax - ymin)"))
def g05(spark, d):
    return topology.micro_units(view(spark, d, "units_b"), 6.0).select("fid")


@query("G11_issue_table", with_views(f"WITH o AS ({_OVERLAPS}) SELECT 'overlap-' || row_number() OVER (ORDER BY least(xmax - xmin, ymax - ymin) DESC, xmin, ymin, xmax, ymax, unit_a, unit_b) AS key, 'overlap' AS kind, unit_a, unit_b, (xmax - xmin) * (ymax - ymin) AS area_deg FROM o"))
def g11(spark, d):
    return topology.issue_table(overlap=topology.overlap_regions(view(spark, d, "units_b"))).select("key", "kind", "unit_a", "unit_b", "area_deg")


@query("N15_validate_summary")
def n15(spark, d):
    h, units = view(spark, d, "hier"), view(spark, d, "names")
    schema = hierarchy.schema_findings(h, [1, 2, 3]).select("kind", F.lit("error").alias("severity"))
    found = codes.check_codes(dissolve.level_units(h, [1, 2, 3])).select("kind", codes.severity(F.col("kind")).alias("severity"))
    b = view(spark, d, "units_b")
    regions = {"overlap": topology.overlap_regions(b), "gap": polygons.gaps(layer(spark, d, "units_b")), "micro-polygon": topology.micro_units(b, 6.0)}
    topo = reduce(DataFrame.unionByName, [r.select(F.lit(kind).alias("kind"), F.lit(topology.severity(kind)).alias("severity")) for kind, r in regions.items()])
    return topology.validate_summary(schema=schema, topology=topo, code=found, name=names.report(names.run_checks(units), units).select("kind", "severity"))
