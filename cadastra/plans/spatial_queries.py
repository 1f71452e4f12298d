"""Queries over box layers: joins, overlap measures, assignment, change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import assign, boxes, change
from cadastra.plans.views import view, with_views
from cadastra.registry import query

LINKED = change.ChangeOptions(link_by_code=True, link_by_name=True)


def _pairs_sql(a: str, b: str, name: str = "pairs") -> str:
    shared = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
    own, other = "(a.xmax - a.xmin) * (a.ymax - a.ymin)", "(b.xmax - b.xmin) * (b.ymax - b.ymin)"
    return f"""{name} AS (SELECT a.fid AS a_fid, b.fid AS b_fid, {shared} AS shared_area, {shared} / nullif({own}, 0) AS coverage_a, {shared} / nullif({other}, 0) AS coverage_b,
        {shared} / nullif({own} + {other} - {shared}, 0) AS iou FROM {a} a JOIN {b} b ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin WHERE {shared} >= 1e-16)"""


_AB, _AO = _pairs_sql("units_a", "units_b"), _pairs_sql("units_a", "overlay")
_BEST = "best AS (SELECT a_fid AS input_fid, b_fid AS overlay_fid, shared_area, coverage_a FROM (SELECT *, row_number() OVER (PARTITION BY a_fid ORDER BY shared_area DESC, b_fid) AS r FROM pairs) t WHERE r = 1)"
#: Code candidates: the codes of the coarse units are written on the fine ones by a rule.
_CODED = "SELECT u.*, 'C' || (CAST(floor((xmin - 5) / 40) AS BIGINT) + CAST(floor(ymin / 40) AS BIGINT) * 10) AS zone FROM units_a u"
_CANDIDATES = f"coded AS ({_CODED}), candidates AS (SELECT p.a_fid, p.b_fid FROM pairs p JOIN coded c ON c.fid = p.a_fid JOIN overlay o ON o.fid = p.b_fid WHERE c.zone = o.code)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "units_a"), view(spark, d, "units_b")


def _overlaid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, o = view(spark, d, "units_a"), view(spark, d, "overlay")
    return a, o, boxes.overlap_pairs(a, o)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    a, o, pairs = _overlaid(spark, d)
    zone = F.concat(F.lit("C"), (F.floor((F.col("xmin") - 5) / 40) + F.floor(F.col("ymin") / 40) * 10).cast("string"))
    return assign.code_candidates(a.withColumn("zone", zone), o, pairs, "zone")


@query("J01_bbox_join", with_views("SELECT a.fid AS a_fid, b.fid AS b_fid FROM units_a a JOIN units_b b ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"))
def j01(spark: SparkSession, d: str) -> DataFrame:
    return boxes.box_join(*_sides(spark, d)).select("a_fid", "b_fid")


@query("J02_intersect_boxes", with_views("SELECT a.fid AS a_fid, b.fid AS b_fid, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax FROM units_a a JOIN units_b b ON a.xmin < b.xmax AND a.xmax > b.xmin AND a.ymin < b.ymax AND a.ymax > b.ymin"))
def j02(spark: SparkSession, d: str) -> DataFrame:
    return boxes.box_join(*_sides(spark, d)).select("a_fid", "b_fid", *boxes.intersection()).where("xmax > xmin and ymax > ymin")


@query("J04_overlap_pairs", with_views(f"WITH {_AB} SELECT * FROM pairs"))
def j04(spark: SparkSession, d: str) -> DataFrame:
    return boxes.overlap_pairs(*_sides(spark, d))


@query("J05_best_overlap", with_views(f"WITH {_AO}, {_BEST} SELECT * FROM best"))
def j05(spark: SparkSession, d: str) -> DataFrame:
    return assign.best_overlap(_overlaid(spark, d)[2])


@query("J06_assign_one_vote", with_views(f"WITH {_AO}, w AS (SELECT b_fid FROM pairs GROUP BY b_fid ORDER BY count(DISTINCT a_fid) DESC, b_fid LIMIT 1) SELECT a.fid AS input_fid, w.b_fid AS overlay_fid FROM units_a a, w"))
def j06(spark: SparkSession, d: str) -> DataFrame:
    a, _, pairs = _overlaid(spark, d)
    return assign.assign_one(a, pairs)


@query("J07_code_candidates", with_views(f"WITH {_AO}, {_CANDIDATES} SELECT * FROM candidates"))
def j07(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query("J08_code_winner", with_views(f"WITH {_AO}, {_CANDIDATES} SELECT a_fid, min(b_fid) AS b_fid FROM candidates GROUP BY a_fid"))
def j08(spark: SparkSession, d: str) -> DataFrame:
    return assign.code_winner(_candidates(spark, d))


@query("J09_assignment_combine", with_views(f"""WITH {_AO}, {_BEST}, {_CANDIDATES}, c AS (SELECT a_fid, min(b_fid) AS b_fid FROM candidates GROUP BY a_fid)
    SELECT coalesce(c.a_fid, best.input_fid) AS input_fid, coalesce(c.b_fid, best.overlay_fid) AS overlay_fid, CASE WHEN c.b_fid IS NOT NULL THEN 'code' ELSE 'spatial' END AS assignment_method,
           CASE WHEN c.b_fid IS NOT NULL THEN coalesce(c.b_fid = best.overlay_fid, false) END AS spatial_agrees FROM c FULL JOIN best ON c.a_fid = best.input_fid"""))
def j09(spark: SparkSession, d: str) -> DataFrame:
    return assign.combined(assign.code_winner(_candidates(spark, d)), assign.best_overlap(_overlaid(spark, d)[2]))


@query("J11_match_groups", with_views(f"WITH {_AO}, {_BEST} SELECT a.fid AS input_fid, coalesce(best.overlay_fid, -1) AS overlay_fid FROM units_a a LEFT JOIN best ON best.input_fid = a.fid"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    a, o, pairs = _overlaid(spark, d)
    return assign.match_groups(a, o, mode="auto", pairs=pairs)


@query("J12_schema_join", with_views(f"""WITH {_AO}, {_BEST}, r AS (SELECT a.*, o.code AS o_code, o.name AS o_name FROM units_a a LEFT JOIN best ON best.input_fid = a.fid LEFT JOIN overlay o ON o.fid = best.overlay_fid)
    SELECT 'code' AS column_name, CAST(sum(CASE WHEN code IS NOT DISTINCT FROM o_code THEN 1 ELSE 0 END) AS BIGINT) AS matches, CAST(sum(CASE WHEN code IS DISTINCT FROM o_code THEN 1 ELSE 0 END) AS BIGINT) AS differs FROM r
    UNION ALL SELECT 'name', CAST(sum(CASE WHEN name IS NOT DISTINCT FROM o_name THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN name IS DISTINCT FROM o_name THEN 1 ELSE 0 END) AS BIGINT) FROM r"""))
def j12(spark: SparkSession, d: str) -> DataFrame:
    a, o, pairs = _overlaid(spark, d)
    return assign.join_columns(a, o, ["code", "name"], pairs)[1]


@query("J16_nearest", with_views("""WITH p AS (SELECT a.fid AS a_fid, b.fid AS b_fid, sqrt(((a.xmin + a.xmax) / 2 - (b.xmin + b.xmax) / 2) * ((a.xmin + a.xmax) / 2 - (b.xmin + b.xmax) / 2) + ((a.ymin + a.ymax) / 2 - (b.ymin + b.ymax) / 2) * ((a.ymin + a.ymax) / 2 - (b.ymin + b.ymax) / 2)) AS distance FROM units_b a JOIN overlay b ON true)
    SELECT a_fid, b_fid, distance FROM (SELECT *, row_number() OVER (PARTITION BY a_fid ORDER BY distance, b_fid) AS r FROM p WHERE distance <= 30) t WHERE r = 1"""))
def j16(spark: SparkSession, d: str) -> DataFrame:
    return boxes.nearest(view(spark, d, "units_b"), view(spark, d, "overlay"), 30.0)


@query("J19_unassigned_anti", with_views(f"WITH {_AO} SELECT fid FROM units_a WHERE fid NOT IN (SELECT a_fid FROM pairs)"))
def j19(spark: SparkSession, d: str) -> DataFrame:
    a, _, pairs = _overlaid(spark, d)
    return a.select("fid").join(pairs.select(F.col("a_fid").alias("fid")), "fid", "left_anti")


@query("J24_reparent", with_views(f"WITH {_pairs_sql('units_b', 'overlay')}, {_BEST} SELECT b.code, o.code AS parent_code FROM units_b b JOIN best ON best.input_fid = b.fid JOIN overlay o ON o.fid = best.overlay_fid"))
def j24(spark: SparkSession, d: str) -> DataFrame:
    b, o = view(spark, d, "units_b"), view(spark, d, "overlay")
    best = assign.best_overlap(boxes.overlap_pairs(b, o)).select(F.col("input_fid").alias("fid"), "overlay_fid")
    return b.join(best, "fid").join(o.select(F.col("fid").alias("overlay_fid"), F.col("code").alias("parent_code")), "overlay_fid").select("code", "parent_code")


@query("J27_join_issues", with_views(f"WITH {_AO}, {_BEST} SELECT 'no-overlap' AS kind, fid, CAST(NULL AS DOUBLE) AS share FROM units_a WHERE fid NOT IN (SELECT input_fid FROM best) UNION ALL SELECT 'low-overlap', input_fid, round(coverage_a, 3) FROM best WHERE coverage_a < 0.6"))
def j27(spark: SparkSession, d: str) -> DataFrame:
    a, _, pairs = _overlaid(spark, d)
    return assign.join_issues(a, pairs, min_overlap=0.6)


@query("X01_unique_values", with_views("SELECT code FROM units_a WHERE code IS NOT NULL GROUP BY code HAVING count(*) = 1"))
def x01(spark: SparkSession, d: str) -> DataFrame:
    return change.unique_values(view(spark, d, "units_a"), "code")


_IDENT = f"""{_AB}, ua AS (SELECT code FROM units_a GROUP BY code HAVING count(*) = 1), ub AS (SELECT code FROM units_b GROUP BY code HAVING count(*) = 1),
    na AS (SELECT name FROM units_a GROUP BY name HAVING count(*) = 1), nb AS (SELECT name FROM units_b GROUP BY name HAVING count(*) = 1),
    keyed AS (SELECT p.*, a.code AS code_a, a.name AS name_a, b.code AS code_b, b.name AS name_b FROM pairs p JOIN units_a a ON a.fid = p.a_fid JOIN units_b b ON b.fid = p.b_fid),
    ident AS (SELECT a_fid, b_fid FROM keyed WHERE (code_a = code_b AND code_a IN (SELECT code FROM ua) AND code_b IN (SELECT code FROM ub)) OR (name_a = name_b AND name_a IN (SELECT name FROM na) AND name_b IN (SELECT name FROM nb))),
    sp AS (SELECT a_fid, b_fid FROM pairs WHERE greatest(coverage_a, coverage_b) >= 0.8),
    guarded AS (SELECT i.* FROM ident i WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.a_fid = i.a_fid AND sp.b_fid <> i.b_fid AND sp.b_fid NOT IN (SELECT b_fid FROM ident))
        AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.b_fid = i.b_fid AND sp.a_fid <> i.a_fid AND sp.a_fid NOT IN (SELECT a_fid FROM ident)))"""


@query("X02_identity_match", with_views(f"WITH {_IDENT} SELECT * FROM ident"))
def x02(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return change.identity_pairs(change.with_keys(boxes.overlap_pairs(a, b), a, b), a, b, LINKED)


# Codes are unique on both sides here, so each unit has one identity partner and every guarded pair is claimed.
@query("X03_identity_claims", with_views(f"WITH {_IDENT} SELECT * FROM guarded"))
def x03(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    pairs = change.with_keys(boxes.overlap_pairs(a, b), a, b)
    return change.identity_claims(pairs, change.identity_pairs(pairs, a, b, LINKED), LINKED)


_MATCHED = f"""{_AB}, keyed AS (SELECT p.*, a.code AS code_a, a.name AS name_a, b.code AS code_b, b.name AS name_b FROM pairs p JOIN units_a a ON a.fid = p.a_fid JOIN units_b b ON b.fid = p.b_fid),
    matched AS (SELECT * FROM keyed WHERE greatest(coverage_a, coverage_b) >= 0.8),
    edges AS (SELECT a_fid * 2 AS u, b_fid * 2 + 1 AS v FROM matched UNION SELECT b_fid * 2 + 1, a_fid * 2 FROM matched),
    nodes AS (SELECT fid * 2 AS node FROM units_a UNION ALL SELECT fid * 2 + 1 FROM units_b),
    reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.node),
    comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
    members AS (SELECT CASE WHEN node % 2 = 0 THEN 'a' ELSE 'b' END AS side, CAST(floor(node / 2) AS BIGINT) AS fid, component FROM comp),
    firsts AS (SELECT component, min(CASE WHEN side = 'a' THEN fid END) AS fa, min(CASE WHEN side = 'b' THEN fid END) AS fb FROM members GROUP BY component),
    named AS (SELECT side, fid, CASE WHEN fa IS NOT NULL THEN 'a' || fa ELSE 'b' || fb END AS cluster FROM members JOIN firsts USING (component)),
    facts AS (SELECT n.cluster, max(m.iou) AS best FROM matched m JOIN named n ON n.side = 'a' AND n.fid = m.a_fid GROUP BY n.cluster),
    sizes AS (SELECT cluster, CAST(sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END) AS BIGINT) AS n_a, CAST(sum(CASE WHEN side = 'b' THEN 1 ELSE 0 END) AS BIGINT) AS n_b FROM named GROUP BY cluster),
    classes AS (SELECT sizes.cluster, n_a, n_b, CASE WHEN n_b = 0 THEN 'removed' WHEN n_a = 0 THEN 'created' WHEN n_a = 1 AND n_b = 1 THEN CASE WHEN best >= 0.98 THEN 'unchanged' ELSE 'modified' END WHEN n_a = 1 THEN 'split' WHEN n_b = 1 THEN 'merge' ELSE 'complex' END AS relationship_class FROM sizes LEFT JOIN facts USING (cluster))"""


@query("X05_components", with_views(f"WITH RECURSIVE {_MATCHED} SELECT * FROM named"))
def x05(spark: SparkSession, d: str) -> DataFrame:
    return change.compare(*_sides(spark, d)).members


@query("X07_cluster_class", with_views(f"WITH RECURSIVE {_MATCHED} SELECT * FROM classes"))
def x07(spark: SparkSession, d: str) -> DataFrame:
    return change.compare(*_sides(spark, d)).classes


@query("X08_changelog", with_views(f"""WITH RECURSIVE {_MATCHED}, rows AS (
        SELECT code_a, name_a, code_b, name_b, relationship_class, 'spatial' AS match_method, round(coverage_a, 3) AS a_in_b, round(coverage_b, 3) AS b_in_a, round(iou, 3) AS similarity FROM matched m JOIN named n ON n.side = 'a' AND n.fid = m.a_fid JOIN classes c USING (cluster)
        UNION ALL SELECT code, name, NULL, NULL, relationship_class, NULL, NULL, NULL, NULL FROM units_a u JOIN named n ON n.side = 'a' AND n.fid = u.fid JOIN classes c USING (cluster) WHERE relationship_class = 'removed'
        UNION ALL SELECT NULL, NULL, code, name, relationship_class, NULL, NULL, NULL, NULL FROM units_b u JOIN named n ON n.side = 'b' AND n.fid = u.fid JOIN classes c USING (cluster) WHERE relationship_class = 'created')
    SELECT *, CAST(0.8 AS DOUBLE) AS threshold_match, CAST(0.98 AS DOUBLE) AS threshold_same, false AS link_by_code, false AS link_by_name, 'either' AS link_mode FROM rows"""))
def x08(spark: SparkSession, d: str) -> DataFrame:
    return change.compare(*_sides(spark, d)).changelog()


@query("X08_changelog_linked")
def x08_linked(spark: SparkSession, d: str) -> DataFrame:
    return change.compare(*_sides(spark, d), LINKED).changelog()


@query("X10_overlay_layer", with_views(f"""WITH RECURSIVE {_MATCHED} SELECT 'b' AS side, u.fid, c.relationship_class, xmin, ymin, xmax, ymax FROM units_b u JOIN named n ON n.side = 'b' AND n.fid = u.fid JOIN classes c USING (cluster)
    UNION ALL SELECT 'a', u.fid, c.relationship_class, xmin, ymin, xmax, ymax FROM units_a u JOIN named n ON n.side = 'a' AND n.fid = u.fid JOIN classes c USING (cluster) WHERE c.relationship_class = 'removed'"""))
def x10(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    got = change.compare(a, b)
    of = got.members.join(got.classes, "cluster")
    parts = [layer.join(of.where(rule), "fid").select("side", "fid", "relationship_class", *boxes.BOX) for layer, rule in ((b, "side = 'b'"), (a, "side = 'a' and relationship_class = 'removed'"))]
    return parts[0].union(parts[1])


@query("X11_reclassify", with_views(f"WITH RECURSIVE {_MATCHED.replace('>= 0.8)', '>= 0.6)').replace('best >= 0.98', 'best >= 0.9')} SELECT * FROM classes"))
def x11(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    first = change.compare(a, b)
    return change.compare(a, b, change.ChangeOptions(tau_match=0.6, tau_same=0.9), first.pairs).classes
