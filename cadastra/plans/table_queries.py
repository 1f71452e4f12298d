"""Queries over hierarchies, codes, aggregates and status tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadastra.operators import codes, dissolve, hierarchy, status
from cadastra.plans.views import view, with_views
from cadastra.registry import query, table

_UNITS = " UNION ALL ".join(
    f"SELECT {n} AS level, 'adm{n}_name' AS name_column, 0 AS name_index, 'adm{n}_code' AS code_column, adm{n}_code AS code, {f'adm{n - 1}_code' if n > 1 else 'CAST(NULL AS VARCHAR)'} AS parent_code, adm{n}_name AS name, count(*) AS row_count FROM hier GROUP BY ALL" for n in (1, 2, 3))


def _hier(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "hier")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return dissolve.level_units(_hier(spark, d), [1, 2, 3])


@query("D01_level_units", with_views(_UNITS))
def d01(spark, d):
    return _units(spark, d)


@query("A01_dissolve", with_views("SELECT adm1_code, adm2_code, min(adm1_name) AS adm1_name, min(adm2_name) AS adm2_name, CAST(sum(fid) AS BIGINT) AS fid, CAST(sum(balance) AS BIGINT) AS balance FROM hier GROUP BY adm1_code, adm2_code"))
def a01(spark, d):
    return dissolve.dissolve(_hier(spark, d), ["adm1_code", "adm2_code"], exclude=["adm3_code"])


@query("A02_group_distincts", with_views("SELECT max(a) AS adm2_name, max(b) AS segment, max(c) AS balance FROM (SELECT count(DISTINCT adm2_name) AS a, count(DISTINCT segment) AS b, count(DISTINCT balance) AS c FROM hier GROUP BY adm1_code) t"))
def a02(spark, d):
    return dissolve.distinct_counts(_hier(spark, d), ["adm1_code"], ["adm2_name", "segment", "balance"])


@query("A05_extent", with_views("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n FROM units_a"))
def a05(spark, d):
    return view(spark, d, "units_a").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count(F.lit(1)).alias("n"))


@query("A08_tuple_distinct", with_views("SELECT count(*) AS n FROM (SELECT DISTINCT adm2_code, adm3_code FROM hier) t"))
def a08(spark, d):
    return _hier(spark, d).agg(F.countDistinct(F.struct("adm2_code", "adm3_code")).alias("n"))


@query("A09_filtered_counts", with_views("SELECT adm1_code, count(*) FILTER (WHERE adm3_code IS NULL) AS missing, count(*) FILTER (WHERE balance < 0) AS negative, bool_or(segment = 'BUILDING') AS any_building FROM hier GROUP BY adm1_code"))
def a09(spark, d):
    return _hier(spark, d).groupBy("adm1_code").agg(F.count_if(F.col("adm3_code").isNull()).alias("missing"), F.count_if(F.col("balance") < 0).alias("negative"), F.bool_or(F.col("segment") == "BUILDING").alias("any_building"))


@query("A11_mode_shape", with_views(r"WITH s AS (SELECT adm1_code, regexp_replace(regexp_replace(adm3_code, '\p{L}', 'A', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM hier WHERE adm3_code IS NOT NULL GROUP BY ALL) SELECT adm1_code, shape, n FROM (SELECT *, row_number() OVER (PARTITION BY adm1_code ORDER BY n DESC, shape DESC) AS r FROM s) t WHERE r = 1"))
def a11(spark, d):
    s = _hier(spark, d).where("adm3_code is not null").groupBy("adm1_code", codes.shape(F.col("adm3_code")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("adm1_code").agg(F.max(F.struct("n", "shape")).alias("m")).select("adm1_code", "m.shape", "m.n")


@query("A14_sorted_sets", with_views("SELECT adm1_code, string_agg(DISTINCT segment, ', ' ORDER BY segment) AS segments, count(DISTINCT segment) AS n FROM hier GROUP BY adm1_code"))
def a14(spark, d):
    return _hier(spark, d).groupBy("adm1_code").agg(F.array_join(F.array_sort(F.collect_set("segment")), ", ").alias("segments"), F.countDistinct("segment").alias("n"))


@query("A18_median", "SELECT l_returnflag, median(l_quantity) AS median_quantity FROM lineitem GROUP BY l_returnflag")
def a18(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity"))


@query("A19_variance_share", with_views("WITH p AS (SELECT CAST(floor(xmin / 100) AS BIGINT) AS g, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM units_a), w AS (SELECT count(*) AS n, var_pop(x) + var_pop(y) AS v FROM p GROUP BY g) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS n_rows, round(1 - sum(n * v) / (SELECT count(*) * (var_pop(x) + var_pop(y)) FROM p), 6) AS r2 FROM w"))
def a19(spark, d):
    return hierarchy.spatial_coherence(view(spark, d, "units_a").withColumn("g", F.floor(F.col("xmin") / 100)), "g")


@query("A22_class_breaks", "SELECT CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS BIGINT) AS class, count(*) AS n FROM lineitem GROUP BY 1")
def a22(spark, d):
    return status.class_breaks(table(spark, d, "lineitem"), "l_quantity", [10, 20, 40])


@query("A23_latest_pivot", with_views("SELECT iso, max(year) AS year, CAST(sum(CASE WHEN status = 'F' AND year = top THEN total ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN status = 'O' AND year = top THEN total ELSE 0 END) AS BIGINT) AS open FROM (SELECT *, max(year) OVER (PARTITION BY iso) AS top FROM orders_work) t GROUP BY iso"))
def a23(spark, d):
    o = view(spark, d, "orders_work")
    per = o.groupBy("iso", "year").agg(F.sum(F.when(F.col("status") == "F", F.col("total")).otherwise(0)).alias("done"), F.sum(F.when(F.col("status") == "O", F.col("total")).otherwise(0)).alias("open"))
    return per.groupBy("iso").agg(F.max(F.struct("year", "done", "open")).alias("m")).select("iso", "m.year", "m.done", "m.open")


@query("W01_report_keys", with_views("SELECT segment || '-' || row_number() OVER (PARTITION BY segment ORDER BY adm3_code NULLS LAST, fid) AS key, fid FROM hier"))
def w01(spark, d):
    w = Window.partitionBy("segment").orderBy(F.col("adm3_code").asc_nulls_last(), "fid")
    return _hier(spark, d).select(F.concat("segment", F.lit("-"), F.row_number().over(w).cast("string")).alias("key"), "fid")


@query("W06_interval_merge", "WITH e AS (SELECT user_id, event_id AS s, event_id + 40 AS t FROM events), a AS (SELECT *, CASE WHEN s > max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY user_id ORDER BY s, t) = 1 THEN 1 ELSE 0 END AS n FROM e), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS i FROM a) SELECT user_id, min(s) AS start, max(t) AS \"end\" FROM b GROUP BY user_id, i")
def w06(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 40).alias("t"))
    return status.merge_intervals(e, "user_id", "s", "t")


@query("P11_schema_fill", with_views("""WITH f AS (SELECT *, CASE WHEN adm3_code IS NOT NULL THEN 3 WHEN adm2_code IS NOT NULL THEN 2 WHEN adm1_code IS NOT NULL THEN 1 END AS adm_lvl FROM hier)
    SELECT fid, adm1_code, adm1_name, CASE WHEN adm_lvl = 1 THEN adm1_code ELSE adm2_code END AS adm2_code, CASE WHEN adm_lvl = 1 THEN adm1_name ELSE adm2_name END AS adm2_name,
           CASE adm_lvl WHEN 1 THEN adm1_code WHEN 2 THEN adm2_code ELSE adm3_code END AS adm3_code, CASE adm_lvl WHEN 1 THEN adm1_name WHEN 2 THEN adm2_name ELSE adm3_name END AS adm3_name, segment, balance, adm_lvl FROM f"""))
def p11(spark, d):
    return dissolve.fill_levels(_hier(spark, d), [1, 2, 3])


@query("P02_refactor", "SELECT c_custkey AS unit, c_name AS adm1_name, c_nationkey AS adm1_code FROM customer")
def p02(spark, d):
    return dissolve.rename_columns(table(spark, d, "customer"), [("c_custkey", "unit"), ("c_name", "adm1_name"), ("c_nationkey", "adm1_code"), ("c_acctbal", ""), ("c_mktsegment", "")])


@query("P12_boundary_level", with_views("WITH p AS (SELECT a.fid AS a_fid, b.fid AS b_fid, CASE WHEN a.adm1_code IS DISTINCT FROM b.adm1_code THEN 1 WHEN a.adm2_code IS DISTINCT FROM b.adm2_code THEN 2 WHEN a.adm3_code IS DISTINCT FROM b.adm3_code THEN 3 END AS level FROM hier a JOIN hier b ON b.fid = a.fid + 1) SELECT level, count(*) AS n FROM p GROUP BY level"))
def p12(spark, d):
    h = _hier(spark, d)
    pre = lambda p: h.select(*[F.col(c).alias(f"{p}_{c}") for c in h.columns])
    pairs = pre("a").join(pre("b"), F.col("b_fid") == F.col("a_fid") + 1)
    return dissolve.boundary_level(pairs, [1, 2, 3]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_COLS = ["adm1_code", "adm1_name", "adm2_code", "adm2_name", "adm3_code", "adm3_name", "segment"]


@query("H01_populated_coverage", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, count(*) AS n_rows FROM hier" for c in _COLS)))
def h01(spark, d):
    return hierarchy.populated(_hier(spark, d), _COLS)


def _contain_sql(finer: str, coarser: str) -> str:
    return f"SELECT '{finer}' AS finer, '{coarser}' AS coarser, count(*) AS groups, CAST(coalesce(sum(CASE WHEN d <> 1 OR f <> n THEN 1 ELSE 0 END), 0) AS BIGINT) AS violators FROM (SELECT count(DISTINCT {coarser}) AS d, count({coarser}) AS f, count(*) AS n FROM hier WHERE {finer} IS NOT NULL GROUP BY {finer}) t"


@query("H02_containment", with_views(" UNION ALL ".join(_contain_sql("adm2_code", c) for c in _COLS if c != "adm2_code")))
def h02(spark, d):
    return hierarchy.containment(_hier(spark, d), "adm2_code", [c for c in _COLS if c != "adm2_code"])


@query("H03_containment_perfect", with_views(f"SELECT coarser, groups >= 10 AND violators = 0 AS perfect FROM ({' UNION ALL '.join(_contain_sql('adm3_code', c) for c in ('adm1_code', 'adm2_code', 'segment'))}) t"))
def h03(spark, d):
    return hierarchy.containment(_hier(spark, d), "adm3_code", ["adm1_code", "adm2_code", "segment"]).select("coarser", ((F.col("groups") >= 10) & (F.col("violators") == 0)).alias("perfect"))


@query("H05_joint_correspondence", with_views("SELECT count(*) AS joint_values, CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS violators, coalesce(max(n), 0) AS widest FROM (SELECT count(DISTINCT adm2_name) AS n FROM hier WHERE adm2_code IS NOT NULL AND adm2_name IS NOT NULL GROUP BY adm2_code) t"))
def h05(spark, d):
    return hierarchy.joint(_hier(spark, d), "adm2_code", "adm2_name")


@query("H06_embeds", with_views("SELECT count(*) AS rows_tested, CAST(coalesce(sum(CASE WHEN coalesce(starts_with(adm3_code, adm2_code), false) THEN 0 ELSE 1 END), 0) AS BIGINT) AS failing, count(DISTINCT CASE WHEN NOT coalesce(starts_with(adm3_code, adm2_code), false) THEN adm3_code END) AS culprits FROM hier WHERE adm2_code IS NOT NULL AND trim(adm2_code) <> ''"))
def h06(spark, d):
    return hierarchy.embeds(_hier(spark, d), "adm3_code", "adm2_code", prefix=True)


@query("H07_code_shaped", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '[0-9]') THEN 1 ELSE 0 END) AS share FROM hier" for c in _COLS)))
def h07(spark, d):
    return hierarchy.code_shares(_hier(spark, d), _COLS)


@query("H08_near_unique", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) / count(*) AS ratio FROM hier" for c in _COLS)))
def h08(spark, d):
    return hierarchy.near_unique(_hier(spark, d), _COLS)


@query("H10_fractional_columns", "SELECT 'p_retailprice' AS column_name, bool_or(p_retailprice <> floor(p_retailprice)) AS fractional FROM part")
def h10(spark, d):
    return hierarchy.fractional(table(spark, d, "part"))


@query("H16_infer_crosswalk")
def h16(spark, d):
    return hierarchy.crosswalk(_hier(spark, d).select("adm1_code", "adm1_name", "adm2_code", "adm2_name", "segment"))


@query("H22_schema_findings", with_views("SELECT 'multiple-parents' AS kind, 2 AS level, adm2_code AS code, count(DISTINCT adm1_code) || ' parents' AS reason FROM hier WHERE adm2_code IS NOT NULL GROUP BY adm2_code HAVING count(DISTINCT adm1_code) > 1 UNION ALL SELECT 'multiple-parents', 3, adm3_code, count(DISTINCT adm2_code) || ' parents' FROM hier WHERE adm3_code IS NOT NULL GROUP BY adm3_code HAVING count(DISTINCT adm2_code) > 1 UNION ALL SELECT 'orphan-child', 2, adm2_code, 'rows without a parent code' FROM hier WHERE adm2_code IS NOT NULL AND adm1_code IS NULL UNION ALL SELECT DISTINCT 'orphan-child', 3, adm3_code, 'rows without a parent code' FROM hier WHERE adm3_code IS NOT NULL AND adm2_code IS NULL"))
def h22(spark, d):
    return hierarchy.schema_findings(_hier(spark, d), [1, 2, 3])


_ADM3 = "SELECT DISTINCT adm2_code AS parent_code, adm3_code AS code FROM hier WHERE adm3_code IS NOT NULL"
_USED = f"used AS (SELECT DISTINCT parent_code, CAST(substr(code, length(parent_code) + 2) AS BIGINT) AS used FROM ({_ADM3}) t WHERE starts_with(code, parent_code || '-') AND regexp_full_match(substr(code, length(parent_code) + 2), '[0-9]+'))"


def _adm3(spark, d):
    return _hier(spark, d).where("adm3_code is not null").select(F.col("adm2_code").alias("parent_code"), F.col("adm3_code").alias("code")).distinct()


@query("C03_used_integers", with_views(f"WITH {_USED} SELECT * FROM used"))
def c03(spark, d):
    return codes.used_integers(_adm3(spark, d), "-")


@query("C04_assign_codes", with_views(f"WITH {_USED}, n AS (SELECT fid, adm2_code AS parent_code, row_number() OVER (PARTITION BY adm2_code ORDER BY adm3_name NULLS LAST, fid) AS r FROM hier WHERE adm3_code IS NULL AND adm2_code IS NOT NULL) SELECT fid, n.parent_code, n.parent_code || '-' || lpad(CAST(coalesce(t.top, 0) + r AS VARCHAR), greatest(4, length(CAST(coalesce(t.top, 0) + r AS VARCHAR)))::INT, '0') AS code FROM n LEFT JOIN (SELECT parent_code, max(used) AS top FROM used GROUP BY parent_code) t ON t.parent_code = n.parent_code"))
def c04(spark, d):
    new = _hier(spark, d).where("adm3_code is null and adm2_code is not null").select("fid", F.col("adm2_code").alias("parent_code"), "adm3_name")
    return codes.assign_codes(_adm3(spark, d), new, codes.CodeFormat(delimiter="-", width=4), ["adm3_name", "fid"]).select("fid", "parent_code", "code")


@query("C06_format_widths", with_views("SELECT CAST(pos - 1 AS INTEGER) AS position, length(p[pos]) AS width, count(*) AS n FROM (SELECT string_split(adm2_code, '-') AS p, unnest(generate_series(1, len(string_split(adm2_code, '-')))) AS pos FROM (SELECT DISTINCT adm2_code FROM hier WHERE adm2_code IS NOT NULL) t) u GROUP BY ALL"))
def c06(spark, d):
    return codes.component_widths(_hier(spark, d), "adm2_code", "-")


@query("C07_undelimited_widths", with_views(f"WITH u AS ({_UNITS}) SELECT level, length(code) - length(parent_code) AS added, count(*) AS n FROM (SELECT DISTINCT level, code, parent_code FROM u WHERE starts_with(code, parent_code)) t GROUP BY ALL"))
def c07(spark, d):
    return codes.undelimited_widths(_units(spark, d))


@query("C09_create_replace", with_views("""WITH a AS (SELECT adm1_code, 'X-' || lpad(CAST(row_number() OVER (ORDER BY adm1_code) AS VARCHAR), 2, '0') AS n1 FROM (SELECT DISTINCT adm1_code FROM hier WHERE adm1_code IS NOT NULL) t),
    b AS (SELECT n1, adm2_code, n1 || '-' || lpad(CAST(row_number() OVER (PARTITION BY n1 ORDER BY adm2_code) AS VARCHAR), 2, '0') AS n2 FROM (SELECT DISTINCT n1, adm2_code FROM hier JOIN a USING (adm1_code) WHERE adm2_code IS NOT NULL) t)
    SELECT fid, a.n1 AS adm1_code, b.n2 AS adm2_code FROM hier h LEFT JOIN a ON a.adm1_code = h.adm1_code LEFT JOIN b ON b.n1 = a.n1 AND b.adm2_code = h.adm2_code"""))
def c09r(spark, d):
    return codes.create_codes(_hier(spark, d).select("fid", "adm1_code", "adm2_code"), [1, 2], codes.CodeFormat("X", "-", 2))


@query("C09_create_embed", with_views("SELECT fid, 'X-' || adm1_code AS adm1_code, CASE WHEN adm2_code IS NOT NULL THEN 'X-' || adm1_code || '-' || adm2_code END AS adm2_code FROM hier"))
def c09e(spark, d):
    return codes.create_codes(_hier(spark, d).select("fid", "adm1_code", "adm2_code"), [1, 2], codes.CodeFormat("X", "-", 2), mode="embed")


@query("C10_digit_overflow", with_views(f"WITH u AS ({_UNITS}) SELECT level, parent_code, count(DISTINCT code) AS child_count, length(CAST(count(DISTINCT code) AS VARCHAR)) AS min_width FROM u WHERE code IS NOT NULL GROUP BY level, parent_code HAVING count(DISTINCT code) > 9"))
def c10(spark, d):
    return codes.overflow(_units(spark, d), 1)


@query("C11_code_checks", with_views(rf"""WITH u AS ({_UNITS}), c AS (SELECT DISTINCT level, code_column, code, parent_code, starts_with(code, parent_code) AS kept FROM u WHERE code IS NOT NULL),
    trust AS (SELECT level FROM c WHERE parent_code IS NOT NULL GROUP BY level HAVING count(*) > 9 AND count(*) FILTER (WHERE kept) >= 0.9 * count(*)),
    s AS (SELECT DISTINCT level, code_column, code, regexp_replace(regexp_replace(code, '\p{{L}}', 'A', 'g'), '[0-9]', '9', 'g') AS shape FROM c),
    f AS (SELECT DISTINCT level, code_column, first_value(shape) OVER w AS usual, first_value(alike) OVER w AS alike, codes FROM (SELECT *, count(*) OVER (PARTITION BY level, shape) AS alike, count(*) OVER (PARTITION BY level) AS codes FROM s) t WHERE codes > 9 WINDOW w AS (PARTITION BY level ORDER BY alike DESC, shape DESC))
    SELECT 'blank-code' AS kind, level, code_column AS column_name, NULL AS code_a, NULL AS code_b, count(*) || ' without a code below ' || coalesce(parent_code, 'the top') AS reason FROM u WHERE code IS NULL GROUP BY level, code_column, parent_code
    UNION ALL SELECT 'name-conflict', level, name_column, code, code, 'goes by ' || string_agg(DISTINCT name, ' / ' ORDER BY name) FROM u WHERE code IS NOT NULL AND trim(name) <> '' GROUP BY level, name_column, code HAVING count(DISTINCT name) > 1
    UNION ALL SELECT CASE WHEN count(DISTINCT row(parent_code, name)) = 1 THEN 'split-unit' ELSE 'duplicate-code' END, 3, code_column, code, NULL, sum(row_count) || ' polygons, ' || count(DISTINCT row(parent_code, name)) || ' meanings' FROM u WHERE level = 3 AND code IS NOT NULL GROUP BY code_column, code HAVING sum(row_count) > 1
    UNION ALL SELECT 'prefix-mismatch', level, code_column, code, parent_code, 'begins otherwise than ' || parent_code FROM c SEMI JOIN trust USING (level) WHERE NOT kept
    UNION ALL SELECT 'format-outlier', s.level, s.code_column, code, NULL, shape || ' among ' || usual FROM s JOIN f ON s.level = f.level AND shape <> usual AND alike >= 0.9 * codes
    UNION ALL SELECT 'format-undetected', level, code_column, NULL, NULL, alike || ' of ' || codes || ' at most share a shape: ' || usual FROM f WHERE alike < 0.9 * codes"""))
def c11(spark, d):
    return codes.check_codes(_units(spark, d)).select("kind", "level", "column_name", "code_a", "code_b", "reason")


_RANK = "CASE priority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"
_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _work(spark, d):
    return view(spark, d, "orders_work")


@query("T01_plan_types", with_views("SELECT year, iso, string_agg(DISTINCT priority, ',' ORDER BY priority) AS types FROM orders_work GROUP BY year, iso"))
def t01(spark, d):
    return status.plan_types(_work(spark, d), ["year", "iso"], "priority")


@query("T02_latest_order", with_views("SELECT iso, year, id, created FROM (SELECT *, row_number() OVER (PARTITION BY iso, year ORDER BY created DESC, id) AS r FROM orders_work) t WHERE r = 1"))
def t02(spark, d):
    return status.latest(_work(spark, d), ["iso", "year"], [F.desc("created"), F.asc("id")]).select("iso", "year", "id", "created")


@query("T03_enriched", with_views("WITH l AS (SELECT iso, year, id FROM (SELECT *, row_number() OVER (PARTITION BY iso, year ORDER BY created DESC, id) AS r FROM orders_work) t WHERE r = 1) SELECT l.iso, l.year, l.id, coalesce(string_agg(DISTINCT o.priority, ',' ORDER BY o.priority), '') AS plan_types FROM l LEFT JOIN orders_work o ON o.iso = l.iso AND o.year >= l.year GROUP BY ALL"))
def t03(spark, d):
    w = _work(spark, d)
    last = status.latest(w, ["iso", "year"], [F.desc("created"), F.asc("id")]).select("iso", "year", "id")
    return status.enriched(last, w, "iso", "year", "priority")


@query("T04_most_active", with_views("SELECT iso, CASE min(CASE status WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'F' END AS status FROM orders_work GROUP BY iso"))
def t04(spark, d):
    return status.most_active(_work(spark, d), "iso", "status", ["O", "P", "F"])


@query("T06_status_counts", with_views("SELECT s.status, coalesce(n, 0) AS n, CAST(place AS BIGINT) AS place FROM (VALUES ('O', 1), ('P', 2), ('F', 3), ('X', 4)) s(status, place) LEFT JOIN (SELECT status, count(*) AS n FROM orders_work GROUP BY status) c ON c.status = s.status"))
def t06(spark, d):
    return status.counts_in_order(_work(spark, d), "status", ["O", "P", "F", "X"])


@query("T07_coverage", with_views("SELECT year, count(DISTINCT iso) AS covered, round(count(DISTINCT iso) / 25, 4) AS share FROM orders_work WHERE priority = '1-URGENT' GROUP BY year"))
def t07(spark, d):
    return status.coverage(_work(spark, d).where("priority = '1-URGENT'"), "year", "iso", 25)


@query("T08_best_ever", with_views(f"SELECT iso, priority AS kind, year FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY {_RANK}, year DESC, priority) AS r FROM orders_work) t WHERE r = 1"))
def t08(spark, d):
    return status.best_ever(_work(spark, d), "iso", "priority", "year", _ORDER)


@query("T09_next_review", with_views("SELECT iso, last, CAST(last + INTERVAL 24 MONTH AS DATE) AS due, CAST(last + INTERVAL 24 MONTH AS DATE) < DATE '2000-01-01' AS overdue, CAST(round(date_diff('day', DATE '2000-01-01', CAST(last + INTERVAL 24 MONTH AS DATE)) / 30.44) AS BIGINT) AS months FROM (SELECT iso, max(created) AS last FROM orders_work GROUP BY iso) t"))
def t09(spark, d):
    return status.next_review(_work(spark, d), "iso", "created", 2, "2000-01-01")


@query("T11_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def t11(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("T12_default_source", with_views("SELECT iso, source AS default_source FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY CASE source WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END) AS r FROM src_match WHERE source IN (1, 2, 3)) t WHERE r = 1"))
def t12(spark, d):
    return status.default_source(view(spark, d, "src_match"), "iso", "source", [3, 1, 2])


@query("T13_level_pick", with_views("SELECT iso, (SELECT s.source FROM src_match s WHERE s.iso = t.iso AND s.units > 0 ORDER BY s.units DESC, s.source LIMIT 1) AS most_units, max(source) AS deepest FROM src_match t WHERE units > 0 GROUP BY iso"))
def t13(spark, d):
    return status.level_pick(view(spark, d, "src_match"), "iso", "source", "units")


@query("T15_level_pivot", with_views("SELECT iso, string_agg(source || ':' || units, ',' ORDER BY source) AS levels FROM src_match GROUP BY iso"))
def t15(spark, d):
    """Units of every level that a country has, in one row."""
    per = view(spark, d, "src_match").groupBy("iso", "source").agg(F.sum("units").alias("units"))
    levels = F.array_sort(F.collect_list(F.struct("source", "units")))
    return per.groupBy("iso").agg(F.array_join(F.transform(levels, lambda x: F.concat_ws(":", x["source"].cast("string"), x["units"].cast("string"))), ",").alias("levels"))


@query("T16_hub_conflict", with_views("SELECT iso, source FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY matched DESC, source) AS r, lead(matched) OVER (PARTITION BY iso ORDER BY matched DESC, source) AS nxt FROM src_match) t WHERE r = 1 AND (nxt IS NULL OR matched >= 2.0 * nxt)"))
def t16(spark, d):
    return status.hub_conflicts(view(spark, d, "src_match"), "iso", "source", "matched")


@query("T20_extract_codes", r"SELECT DISTINCT regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) AS code FROM pages WHERE regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) <> ''")
def t20(spark, d):
    code = F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1)
    return table(spark, d, "pages").select(code.alias("code")).where("code <> ''").distinct()


@query("S21_html_title", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def s21(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))
