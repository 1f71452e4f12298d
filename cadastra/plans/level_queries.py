"""Queries over the levels of a hierarchy."""

from __future__ import annotations


from pyspark.sql import functions as F

from cadastra.operators import codes, hierarchy, levels
from cadastra.plans.views import view, with_views
from cadastra.registry import query

#: hier with columns named unlike the others, a missing kind, and a grouping that is no level.
_ODD = "SELECT *, upper(adm2_name) AS ADM2_altName, adm1_name || ' land' AS adm1_altname, CASE WHEN fid % 53 = 0 THEN NULL ELSE adm1_code END AS Adm1Type FROM hier"


def _hier(spark, d):
    return view(spark, d, "hier")


def _odd(spark, d):
    kept = F.when(F.col("fid") % 53 != 0, F.col("adm1_code"))
    return _hier(spark, d).withColumns({"ADM2_altName": F.upper("adm2_name"), "adm1_altname": F.concat("adm1_name", F.lit(" land")), "Adm1Type": kept})


@query("H09_combined_distinct", with_views("SELECT count(*) AS pairs FROM (SELECT DISTINCT adm1_code, adm2_name FROM hier) t"))
def h09(spark, d):
    return _hier(spark, d).select("adm1_code", "adm2_name").distinct().agg(F.count(F.lit(1)).alias("pairs"))


@query("H04_bijective", with_views("""WITH s AS (SELECT adm2_code AS a, adm2_name AS b FROM hier),
    x AS (SELECT count(*) AS groups, count(*) FILTER (WHERE n <> 1 OR holes) AS bad FROM (SELECT a, count(DISTINCT b) AS n, bool_or(b IS NULL) AS holes FROM s WHERE a IS NOT NULL GROUP BY a) t),
    y AS (SELECT count(*) AS groups, count(*) FILTER (WHERE n <> 1 OR holes) AS bad FROM (SELECT b, count(DISTINCT a) AS n, bool_or(a IS NULL) AS holes FROM s WHERE b IS NOT NULL GROUP BY b) t)
    SELECT (x.bad = 0 OR (x.bad = 1 AND x.groups > 2)) AND (y.bad = 0 OR (y.bad = 1 AND y.groups > 2)) AS bijective FROM x, y"""))
def h04(spark, d):
    there = hierarchy.containment(_hier(spark, d), "adm2_code", ["adm2_name"]).union(hierarchy.containment(_hier(spark, d), "adm2_name", ["adm2_code"]))
    good = (F.col("violators") == 0) | ((F.col("violators") == 1) & (F.col("groups") > hierarchy.TOLERANCE_GROUPS))
    return there.agg(F.bool_and(good).alias("bijective"))


@query("H17_level_columns", with_views("""SELECT 1 AS level, 'adm1_code' AS column_name, true AS is_code, 'code' AS kind, count(DISTINCT adm1_code) AS units FROM hier UNION ALL SELECT 1, 'adm1_name', false, 'name', count(DISTINCT adm1_name) FROM hier
    UNION ALL SELECT 2, 'adm2_code', true, 'code', count(DISTINCT adm2_code) FROM hier UNION ALL SELECT 2, 'adm2_name', false, 'name', count(DISTINCT adm2_name) FROM hier"""))
def h17(spark, d):
    """The columns of the levels that the values show; of adm3 they show none, as its names repeat."""
    df = _hier(spark, d).drop("adm3_code", "adm3_name", "segment", "balance")
    found = levels.detect_levels(df)
    counts = {r.column_name: r.distinct_values for r in hierarchy.populated(df, df.columns).collect()}
    rows = [(n, c, c == lv.code, lv.kinds.get(c, ""), counts[c]) for n, lv in found.items() for c in lv.columns]
    return spark.createDataFrame(rows, "level int, column_name string, is_code boolean, kind string, units long")


_GUARD = "SELECT '{0}' AS member, (SELECT coalesce(max(n), 0) FROM (SELECT count(DISTINCT {0}) AS n FROM hier WHERE adm2_code IS NOT NULL GROUP BY adm2_code) t) AS variants, count(DISTINCT row(adm1_code, adm2_code)) AS units, count(DISTINCT row(adm1_code, {0})) AS member_values FROM hier WHERE {0} IS NOT NULL"


@query("H18_cluster_guard", with_views("SELECT *, CASE WHEN variants > 1 THEN 'fragments' WHEN units > 0 AND 1 - member_values / units > 0.3 THEN 'coarser' END AS problem FROM (" + " UNION ALL ".join(_GUARD.format(c) for c in ("adm2_name", "adm1_name", "adm3_code")) + ") g"))
def h18(spark, d):
    return levels.cluster_guard(_hier(spark, d), "adm2_code", ["adm2_name", "adm1_name", "adm3_code"], "adm1_code")


@query("H19_template_levels", with_views("SELECT n AS level, count(DISTINCT CASE n WHEN 1 THEN adm1_code WHEN 2 THEN adm2_code ELSE adm3_code END) AS units FROM hier, (VALUES (1), (2), (3)) v(n) GROUP BY n"))
def h19(spark, d):
    df = _hier(spark, d)
    found = levels.template_levels(df.columns)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(levels.at_level(levels.CODE, n)).alias("code")) for n in found]))
    return df.select(each.alias("e")).select("e.*").groupBy("level").agg(F.count_distinct("code").alias("units"))


@query("H20_canonical_order", with_views("SELECT fid, adm3_name, adm3_code, adm2_name, ADM2_altName AS a2, adm2_code, adm1_name, adm1_altname, adm1_code FROM (" + _ODD + ") o"))
def h20(spark, d):
    df = _odd(spark, d).drop("segment", "balance", "Adm1Type")
    order, _ = levels.canonical_order(df.columns)
    assert order[:2] == ["adm3_name", "adm3_code"] and order[-2:] == ["fid", "ADM2_altName"], order
    return df.select(*order).withColumnRenamed("ADM2_altName", "a2")


_LINKS = " UNION ALL ".join(
    f"""SELECT 'multiple-parents' AS kind, {n} AS level, 'adm{n}_code' AS column_name, adm{n}_code AS code, 'lies under ' || string_agg(DISTINCT adm{n - 1}_code, ', ' ORDER BY adm{n - 1}_code) AS reason FROM hier WHERE adm{n}_code IS NOT NULL GROUP BY adm{n}_code HAVING count(DISTINCT adm{n - 1}_code) > 1
    UNION ALL SELECT DISTINCT 'orphan-child', {n}, 'adm{n}_code', adm{n}_code, 'has rows without adm{n - 1}_code' FROM hier WHERE adm{n}_code IS NOT NULL AND adm{n - 1}_code IS NULL"""
    for n in (2, 3))


@query("H22_schema_checks", with_views(f"""SELECT *, CASE WHEN kind IN ('column-naming', 'column-set-mismatch') THEN 'warn' ELSE 'error' END AS severity FROM ({_LINKS}
    UNION ALL SELECT * FROM (VALUES ('column-naming', 2, 'ADM2_altName', NULL, 'its like at another level is adm1_altname'), ('column-naming', 1, 'Adm1Type', NULL, 'unlike the other columns of level 1'), ('column-set-mismatch', 3, NULL, NULL, 'lacks the like of ADM2_altName')) v) f"""))
def h22_checks(spark, d):
    """All kinds of findings that a table with oddly named columns has."""
    return levels.schema_checks(_odd(spark, d), levels.CODE)


@query("P05_guess_columns", with_views("SELECT CAST(count(adm1_code) AS BIGINT) AS coded, CAST(count(adm1_name) AS BIGINT) AS named FROM hier"))
def p05(spark, d):
    df = _hier(spark, d)
    code, name = levels.guess_columns([c for c in df.columns if "3" not in c and "2" not in c])
    return df.agg(F.count(code).alias("coded"), F.count(name).alias("named"))


@query("A03_finer_columns", with_views("SELECT DISTINCT fid, adm1_code, adm1_name, segment, balance FROM hier"))
def a03(spark, d):
    df = _hier(spark, d)
    return df.drop(*levels.finer_columns(df.columns, ["adm1_code"])).distinct()


@query("C05_seeded_codes", with_views("SELECT DISTINCT adm1_code, adm2_name, adm2_name AS seeded FROM hier WHERE adm2_name IS NOT NULL"))
def c05(spark, d):
    from cadastra.operators.tables import seeded_codes

    units = _hier(spark, d).select("adm1_code", "adm2_name").where("adm2_name is not null").distinct()
    return seeded_codes(units, "seeded", "adm2_name", "adm1_code")


@query("C02_code_parts", with_views("SELECT DISTINCT adm3_code, regexp_replace(adm3_code, '-[^-]*$', '') AS prefix, regexp_extract(adm3_code, '[^-]*$') AS last FROM hier WHERE adm3_code LIKE '%-%'"))
def c02(spark, d):
    df = _hier(spark, d).where("adm3_code like '%-%'").select("adm3_code").distinct()
    return df.select("adm3_code", codes.parent_prefix(F.col("adm3_code"), "-").alias("prefix"), codes.last_component(F.col("adm3_code"), "-").alias("last"))
