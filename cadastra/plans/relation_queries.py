"""Queries of the relational operators that the tools share."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.operators import change, tables
from cadastra.plans.spatial_queries import _MATCHED, _sides
from cadastra.plans.views import view, with_views
from cadastra.registry import query, table


@query("P01_star_without", with_views("SELECT * EXCLUDE (xmin, ymin) REPLACE (upper(name) AS name) FROM units_a"))
def p01(spark, d):
    return view(spark, d, "units_a").drop("xmin", "ymin").withColumn("name", F.upper("name"))


@query("P04_noise_columns", "SELECT * FROM (VALUES ('OBJECTID'), ('objectid_1'), ('Shape__Area'), ('shape_le_1'), ('fid_orig'), ('globalid_3')) t(name)")
def p04(spark, d):
    from cadastra.operators.hierarchy import is_noise

    names = ["OBJECTID", "objectid_1", "Shape__Area", "shape_le_1", "fid_orig", "globalid_3", "shape_le_12", "id", "adm1_code", "objectids", "area_1"]
    return spark.createDataFrame([(c,) for c in names if is_noise(c)], "name string")


@query("P06_keyed_layer", with_views("SELECT u.fid, nullif(coalesce(h.adm1_code, '') || coalesce(h.adm2_code, ''), '') AS code, CAST(h.balance AS VARCHAR) AS name, xmin, ymin, xmax, ymax FROM units_a u LEFT JOIN hier h ON h.fid = u.fid"))
def p06(spark, d):
    return tables.keyed(view(spark, d, "units_a"), view(spark, d, "hier"), ["adm1_code", "adm2_code"], "balance")


@query("P07_micro_and_thin", with_views("SELECT fid, 2 * (xmax - xmin) * (ymax - ymin) <= 6 * 2 * (xmax - xmin + ymax - ymin) AS micro, round(4 * pi() * (xmax - xmin) * (ymax - ymin) / pow(2 * (xmax - xmin + ymax - ymin), 2), 9) AS thinness FROM units_b"))
def p07(spark, d):
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return view(spark, d, "units_b").select("fid", (2 * w * h <= 6 * 2 * (w + h)).alias("micro"), F.round(4 * F.pi() * w * h / F.pow(2 * (w + h), F.lit(2)), 9).alias("thinness"))


@query("P14_country_units", with_views("SELECT adm2_code, count(*) AS n FROM hier WHERE substr(adm2_code, 1, 3) = 'R1-' AND NOT coalesce(adm3_name IN ('BUILDING 5', 'MACHINERY 7'), false) GROUP BY adm2_code"))
def p14(spark, d):
    return tables.country_units(view(spark, d, "hier"), "R1-", "adm2_code", "adm3_name", ["BUILDING 5", "MACHINERY 7"]).groupBy("adm2_code").agg(F.count(F.lit(1)).alias("n"))


@query("J18_semi_join", with_views("SELECT fid FROM units_a SEMI JOIN units_b USING (code)"))
def j18(spark, d):
    return view(spark, d, "units_a").join(view(spark, d, "units_b"), "code", "left_semi").select("fid")


@query("J22_strip_cross", with_views("SELECT fid, n AS strip, xmin + (xmax - xmin) * n / 4 AS x FROM units_a, (VALUES (0), (1), (2), (3)) v(n)"))
def j22(spark, d):
    """Strips of a unit: a fixed number of rows each, exploded in place."""
    return view(spark, d, "units_a").select("fid", "xmin", "xmax", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("strip")).select("fid", "strip", (F.col("xmin") + (F.col("xmax") - F.col("xmin")) * F.col("strip") / 4).alias("x"))


@query("J23_suppress", with_views("SELECT fid, code FROM units_a a WHERE NOT EXISTS (SELECT 1 FROM overlay o WHERE o.xmin <= a.xmin AND a.xmax <= o.xmax AND o.ymin <= a.ymin AND a.ymax <= o.ymax AND o.fid % 2 = 0 AND a.fid % 3 = 0) OR fid % 3 <> 0"))
def j23(spark, d):
    """Units but for every third one that an even zone covers."""
    from cadastra.operators.boxes import overlap_pairs

    a, zones = view(spark, d, "units_a"), view(spark, d, "overlay").where("fid % 2 = 0")
    inside = overlap_pairs(a.where("fid % 3 = 0"), zones).where("coverage_a >= 1").select(F.col("a_fid").alias("fid"))
    return tables.suppress(a, inside, ["fid"]).select("fid", "code")


@query("J23_write_back", with_views("SELECT a.fid, CASE WHEN b.code IS NULL THEN a.name ELSE b.name END AS name, a.code FROM units_a a LEFT JOIN (SELECT code, min(name) AS name FROM units_b GROUP BY code) b ON b.code IS NOT DISTINCT FROM a.code"))
def j23_update(spark, d):
    new = view(spark, d, "units_b").groupBy("code").agg(F.min("name").alias("name"))
    return tables.write_back(view(spark, d, "units_a"), new, ["code"], ["name"]).select("fid", "name", "code")


@query("J26_stored_matches", with_views("WITH p AS (SELECT iso, min(source) AS pick FROM src_match WHERE matched > 0 GROUP BY iso) SELECT m.iso, m.source, m.units FROM src_match m JOIN p ON p.iso = m.iso AND p.pick = m.depth % 7 + 1"))
def j26(spark, d):
    m = view(spark, d, "src_match")
    picks = m.where("matched > 0").groupBy("iso").agg(F.min("source").alias("selected_source"))
    return tables.stored_matches(m.withColumn("preferred_source", F.col("depth") % 7 + 1), picks).select("iso", "source", "units")


_FLAGS = "SELECT 'k' || (fid % 5) AS key, fid FROM units_b WHERE fid % 3 = 0"


@query("J28_flagged_units", with_views(f"SELECT key, f.fid, xmin, ymin, xmax, ymax FROM ({_FLAGS}) f JOIN units_b u ON u.fid = f.fid"))
def j28(spark, d):
    return tables.flagged_units(_flags(spark, d), view(spark, d, "units_b"))


@query("J28_flagged_bounds", with_views(f"SELECT key, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM ({_FLAGS}) f JOIN units_b u ON u.fid = f.fid GROUP BY key"))
def j28_bounds(spark, d):
    return tables.flagged_bounds(tables.flagged_units(_flags(spark, d), view(spark, d, "units_b")))


def _flags(spark, d):
    return view(spark, d, "units_b").where("fid % 3 = 0").select(F.concat(F.lit("k"), (F.col("fid") % 5).cast("string")).alias("key"), "fid")


@query("A07_distincts_one_scan", with_views("SELECT count(DISTINCT iso) AS iso, count(DISTINCT status) AS status, count(DISTINCT priority) AS priority, count(DISTINCT year) AS year FROM orders_work"))
def a07(spark, d):
    return view(spark, d, "orders_work").agg(*[F.count_distinct(c).alias(c) for c in ("iso", "status", "priority", "year")])


@query("A10_flag_shares", with_views("SELECT iso, bool_or(status = 'P') AS any_pending, round(avg(CASE WHEN status = 'F' THEN 1 ELSE 0 END), 9) AS done FROM orders_work GROUP BY iso"))
def a10(spark, d):
    return view(spark, d, "orders_work").groupBy("iso").agg(F.bool_or(F.col("status") == "P").alias("any_pending"), F.round(F.avg((F.col("status") == "F").cast("int")), 9).alias("done"))


@query("A12_arg_max", with_views("SELECT iso, arg_max(id, (total, id)) AS id FROM orders_work GROUP BY iso"))
def a12(spark, d):
    return view(spark, d, "orders_work").groupBy("iso").agg(F.max_by("id", F.struct("total", "id")).alias("id"))


@query("A13_longest_value", with_views("SELECT segment, max(struct_pack(l := length(adm3_name), v := adm3_name)).v AS longest FROM hier WHERE adm3_name IS NOT NULL GROUP BY segment"))
def a13(spark, d):
    return view(spark, d, "hier").where("adm3_name is not null").groupBy("segment").agg(F.max(F.struct(F.length("adm3_name").alias("l"), F.col("adm3_name").alias("v")))["v"].alias("longest"))


@query("A15_joined_strings", with_views("SELECT iso, string_agg(DISTINCT priority, ' / ' ORDER BY priority) AS priorities FROM orders_work GROUP BY iso"))
def a15(spark, d):
    return view(spark, d, "orders_work").groupBy("iso").agg(F.array_join(F.array_sort(F.collect_set("priority")), " / ").alias("priorities"))


@query("A16_paired_arrays", with_views("SELECT iso, array_to_string(array_agg(source ORDER BY units DESC, source), ',') AS sources, array_to_string(array_agg(units ORDER BY units DESC, source), ',') AS units FROM src_match GROUP BY iso"))
def a16(spark, d):
    held = F.array_sort(F.collect_list(F.struct((-F.col("units")).alias("back"), "source")))
    text = lambda f: F.array_join(F.transform("held", lambda x: f(x).cast("string")), ",")
    return view(spark, d, "src_match").groupBy("iso").agg(held.alias("held")).select("iso", text(lambda x: x["source"]).alias("sources"), text(lambda x: -x["back"]).alias("units"))


@query("A17_any_value", with_views("SELECT adm2_code, min(adm2_name) AS name FROM hier WHERE adm2_code IS NOT NULL GROUP BY adm2_code"))
def a17(spark, d):
    """Any value is the least one here, so that runs agree."""
    return view(spark, d, "hier").where("adm2_code is not null").groupBy("adm2_code").agg(F.min("adm2_name").alias("name"))


@query("A20_having", with_views("SELECT adm1_code, adm2_code, count(*) AS n FROM hier GROUP BY ALL HAVING count(*) > 3 AND count(DISTINCT segment) > 2"))
def a20(spark, d):
    return view(spark, d, "hier").groupBy("adm1_code", "adm2_code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment").alias("s")).where("n > 3 and s > 2").drop("s")


@query("A21_global_exists", with_views("SELECT count(*) AS n, EXISTS (SELECT 1 FROM units_b WHERE code LIKE '%b') AS has_parts FROM units_a"))
def a21(spark, d):
    parts = view(spark, d, "units_b").agg(F.coalesce(F.bool_or(F.col("code").endswith("b")), F.lit(False)).alias("has_parts"))
    return view(spark, d, "units_a").agg(F.count(F.lit(1)).alias("n")).crossJoin(parts)  # one row each


@query("W02_top_one", with_views("SELECT iso, id, total FROM orders_work QUALIFY row_number() OVER (PARTITION BY iso ORDER BY total DESC, id) = 1"))
def w02(spark, d):
    best = view(spark, d, "orders_work").groupBy("iso").agg(F.max(F.struct("total", (-F.col("id")).alias("back"))).alias("m"))
    return best.select("iso", (-F.col("m.back")).alias("id"), F.col("m.total").alias("total"))


@query("W03_numbering", with_views("SELECT fid, adm1_code, CAST(100 + row_number() OVER (PARTITION BY adm1_code ORDER BY fid) AS BIGINT) AS number FROM hier"))
def w03(spark, d):
    return view(spark, d, "hier").select("fid", "adm1_code", (F.lit(100) + F.row_number().over(Window.partitionBy("adm1_code").orderBy("fid"))).cast("long").alias("number"))


@query("W05_segments", with_views("SELECT unit, i, x0, y0, x, y FROM (SELECT *, lag(x) OVER (PARTITION BY unit ORDER BY i) AS x0, lag(y) OVER (PARTITION BY unit ORDER BY i) AS y0 FROM (SELECT fid AS unit, i, CASE WHEN i IN (1, 2) THEN xmax ELSE xmin END AS x, CASE WHEN i IN (2, 3) THEN ymax ELSE ymin END AS y FROM units_a, (VALUES (0), (1), (2), (3), (4)) v(i)) p) s WHERE x0 IS NOT NULL"))
def w05(spark, d):
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("xmax" if i in (1, 2) else "xmin").alias("x"), F.col("ymax" if i in (2, 3) else "ymin").alias("y")) for i in range(5)]))
    points = view(spark, d, "units_a").select(F.col("fid").alias("unit"), corner.alias("p")).select("unit", "p.*")
    w = Window.partitionBy("unit").orderBy("i")
    return points.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)}).where("x0 is not null").select("unit", "i", "x0", "y0", "x", "y")


@query("W07_kept_maximum", with_views("SELECT iso, id, max(total) FILTER (WHERE status = 'F') OVER (PARTITION BY iso) AS best_done FROM orders_work"))
def w07(spark, d):
    best = F.max(F.when(F.col("status") == "F", F.col("total"))).over(Window.partitionBy("iso"))
    return view(spark, d, "orders_work").select("iso", "id", best.alias("best_done"))


@query("W08_keep_flag", with_views("SELECT iso, id, row_number() OVER (PARTITION BY iso ORDER BY status = 'F' DESC, total DESC, id) = 1 AS kept FROM orders_work"))
def w08(spark, d):
    r = F.row_number().over(Window.partitionBy("iso").orderBy((F.col("status") == "F").desc(), F.desc("total"), "id"))
    return view(spark, d, "orders_work").select("iso", "id", (r == 1).alias("kept"))


@query("L05_first_samples", with_views("SELECT column_name, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS r FROM (SELECT DISTINCT 'adm2_name' AS column_name, adm2_name AS v FROM hier UNION SELECT DISTINCT 'balance', CAST(balance AS VARCHAR) FROM hier) d WHERE v IS NOT NULL) t WHERE r <= 5 GROUP BY column_name"))
def l05(spark, d):
    return tables.first_samples(view(spark, d, "hier"), ["adm2_name", "balance"], 5)


@query("U02_union_distinct", with_views("SELECT code FROM units_a UNION SELECT code FROM units_b"))
def u02(spark, d):
    return view(spark, d, "units_a").select("code").union(view(spark, d, "units_b").select("code")).distinct()


@query("U03_union_by_name", with_views("SELECT fid, code, NULL AS zone FROM units_a UNION ALL SELECT fid, NULL, name FROM overlay"))
def u03(spark, d):
    zones = view(spark, d, "overlay").select("fid", F.col("name").alias("zone"))
    return view(spark, d, "units_a").select("fid", "code").unionByName(zones, allowMissingColumns=True)


@query("U04_distinct", with_views("SELECT DISTINCT adm1_code, segment FROM hier"))
def u04(spark, d):
    return view(spark, d, "hier").select("adm1_code", "segment").distinct()


@query("S19_decisions", """SELECT upper(trim(n_name[1:3])) AS iso3, trim(n_name) AS country_name, CASE WHEN n_nationkey % 4 IN (1, 2) THEN 's' || n_regionkey END AS selected_source, n_nationkey % 4 = 3 AS no_source_suitable, n_nationkey % 2 = 0 AS accepted, '' AS rationale, NULL AS last_updated
    FROM nation QUALIFY row_number() OVER (PARTITION BY upper(trim(n_name[1:3])) ORDER BY n_nationkey DESC) = 1""")
def s19(spark, d):
    """A sheet of text cells made of the nations: names in any case, spaces, the word null, empty cells."""
    k = F.col("n_nationkey")
    source = F.when(k % 4 == 3, " NULL ").when(k % 4 == 0, "").otherwise(F.concat(F.lit(" s"), F.col("n_regionkey").cast("string")))
    sheet = table(spark, d, "nation").select(k.alias("_row"), F.lower(F.concat(F.lit(" "), F.substring("n_name", 1, 3))).alias("ISO3 "), F.concat("n_name", F.lit("  ")).alias("Country_Name"), source.alias("selected_source"), F.when(k % 2 == 0, "TRUE ").otherwise("no").alias("Accepted"))
    return tables.decisions(sheet)


_CELL = r"regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&middot;', '&middot;', 'g')"


@query("S21_html_rows", f"""SELECT page_id, CAST(r - 1 AS BIGINT) AS row, array_to_string(list_transform(regexp_extract_all(inner_html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1), lambda c: trim(replace(replace(replace(replace({_CELL.format('c')}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))), '|') AS cells
    FROM (SELECT page_id, unnest(l) AS inner_html, generate_subscripts(l, 1) AS r FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul(?:\\s[^>]*)?>(.*?)</ul>', 1) AS l FROM pages) p) t WHERE len(regexp_extract_all(inner_html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1)) > 0""")
def s21_rows(spark, d):
    """The pages hold lists, not tables: rows are their ul, cells their li."""
    return tables.html_rows(table(spark, d, "pages"), "page_id", "html", "ul", "li").select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("S23_catalog", "SELECT column_name, data_type FROM (VALUES ('adm1_code', 'string'), ('adm1_name', 'string'), ('adm2_code', 'string'), ('adm2_name', 'string'), ('adm3_code', 'string'), ('adm3_name', 'string'), ('balance', 'bigint'), ('fid', 'bigint'), ('segment', 'string')) t(column_name, data_type)")
def s23(spark, d):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in view(spark, d, "hier").schema], "column_name string, data_type string")


@query("S24_generated_rows", "SELECT x AS n, x * x AS square FROM range(0, 1000, 7) t(x)")
def s24(spark, d):
    return spark.range(0, 1000, 7).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square"))


_VALUES = ["l_quantity % 3", "l_partkey % 2", "l_suppkey % 4"]


@query("T18_decoded_rows", "SELECT l_orderkey, l_linenumber, position, CASE position WHEN 0 THEN CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(l_quantity % 3 AS BIGINT) AS VARCHAR) END WHEN 1 THEN CASE l_partkey % 2 WHEN 0 THEN 'even' END ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS value FROM lineitem, (VALUES (0), (1), (2)) p(position)")
def t18(spark, d):
    """Line items, written as rows of changes and read back; the odd code has no name."""
    key, line = "l_orderkey", "l_linenumber"
    v = [F.when(F.col(line) % 4 != 0, (F.col("l_quantity") % 3).cast("long")), (F.col("l_partkey") % 2).cast("long"), (F.col("l_suppkey") % 4).cast("long")]
    df = table(spark, d, "lineitem").select(key, line, *[c.alias(f"v{i}") for i, c in enumerate(v)])
    w = Window.partitionBy(key).orderBy(line)
    first = F.row_number().over(w) == 1
    same = [(~first & F.col(f"v{i}").eqNullSafe(F.lag(f"v{i}").over(w))).alias(f"s{i}") for i in range(3)]
    df = df.select("*", *same)
    bits = lambda test: sum((F.when(test(i), 1 << i).otherwise(0) for i in range(3)), F.lit(0))
    none = lambda i: ~F.col(f"s{i}") & F.col(f"v{i}").isNull()
    values = F.array_compact(F.array(*[F.when(~F.col(f"s{i}"), F.col(f"v{i}")) for i in range(3)]))
    rows = df.select(key, line, bits(lambda i: F.col(f"s{i}")).alias("repeat"), bits(none).alias("empty"), values.alias("values"))
    return tables.decode_rows(rows, key, line, 3, spark.createDataFrame([(1, 0, "even")], "position int, code long, name string"))


_UNDER = ["T_00_04", "T_05_09", "T_10_14"]


@query("T21_population", with_views("""WITH l AS (SELECT unit, max(year) AS year FROM people WHERE grp = 'T_TL' GROUP BY unit), s AS (
    SELECT unit, year, sum(people) FILTER (WHERE grp = 'T_TL') AS t, sum(people) FILTER (WHERE grp = 'M_TL') AS m, sum(people) FILTER (WHERE grp = 'F_TL') AS f, sum(people) FILTER (WHERE grp = 'T_00_04') AS t5,
        CASE WHEN count(*) FILTER (WHERE grp IN ('T_00_04', 'T_05_09', 'T_10_14')) = 3 THEN sum(people) FILTER (WHERE grp IN ('T_00_04', 'T_05_09', 'T_10_14')) END AS u FROM people JOIN l USING (unit, year) GROUP BY unit, year)
    SELECT unit, year, round(t / (10 + unit), 6) AS density, round(100 * t5 / t, 6) AS under5, round(100 * (t - u) / t, 6) AS over60, round(100 * m / nullif(f, 0), 6) AS sex_ratio FROM s"""))
def t21(spark, d):
    return _metrics(spark, d)


def _metrics(spark, d):
    people = view(spark, d, "people")
    areas = people.select("unit").distinct().withColumn("area", F.col("unit") + 10)
    return tables.population_metrics(people, areas, under=_UNDER)


@query("T21_classes", with_views("""WITH l AS (SELECT unit, max(year) AS year FROM people WHERE grp = 'T_TL' GROUP BY unit), s AS (SELECT unit, round(100 * sum(people) FILTER (WHERE grp = 'M_TL') / nullif(sum(people) FILTER (WHERE grp = 'F_TL'), 0), 6) AS v FROM people JOIN l USING (unit, year) GROUP BY unit),
    c AS (SELECT CASE WHEN v IS NULL THEN -1 WHEN v < 90 THEN 0 WHEN v < 95 THEN 1 WHEN v < 105 THEN 2 WHEN v < 1100 THEN 3 ELSE 4 END AS class FROM s) SELECT class, count(*) AS n, CASE class WHEN -1 THEN 'no data' WHEN 0 THEN 'under 90' WHEN 1 THEN '90 to 95' WHEN 2 THEN '95 to 105' WHEN 3 THEN '105 to 1,100' ELSE '1,100 and over' END AS label FROM c GROUP BY class"""))
def t21_classes(spark, d):
    return tables.metric_classes(_metrics(spark, d), "sex_ratio", [90, 95, 105, 1100])


@query("X09_long_table", with_views(f"""WITH RECURSIVE {_MATCHED} SELECT cluster, relationship_class, a_fid, code_a AS a_code, name_a AS a_name, b_fid, code_b AS b_code, name_b AS b_name, coverage_a, coverage_b, iou FROM matched m JOIN named n ON n.side = 'a' AND n.fid = m.a_fid JOIN classes c USING (cluster)
    UNION ALL SELECT cluster, relationship_class, u.fid, u.code, u.name, NULL, NULL, NULL, NULL, NULL, NULL FROM units_a u JOIN named n ON n.side = 'a' AND n.fid = u.fid JOIN classes c USING (cluster) WHERE n_b = 0
    UNION ALL SELECT cluster, relationship_class, NULL, NULL, NULL, u.fid, u.code, u.name, NULL, NULL, NULL FROM units_b u JOIN named n ON n.side = 'b' AND n.fid = u.fid JOIN classes c USING (cluster) WHERE n_a = 0"""))
def x09(spark, d):
    return tables.long_table(change.compare(*_sides(spark, d)))
