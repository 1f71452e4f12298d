"""Queries of lookups, code updates and smaller status reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.operators import assign, boxes, codes, layerview, names, status, update
from cadastra.plans.views import view, with_views
from cadastra.registry import query, table
from cadastra.storage import stored


@query("S13_layer_bounds", with_views("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM units_b"))
def s13(spark, d):
    return layerview.bounds(view(spark, d, "units_b"))


@query("S14_attributes_at", with_views("WITH h AS (SELECT code, name FROM units_a WHERE xmin <= 100 AND xmax >= 100 AND ymin <= 15 AND ymax >= 15 ORDER BY fid LIMIT 1) SELECT 'code' AS name, code AS value FROM h UNION ALL SELECT 'name', name FROM h"))
def s14(spark, d):
    return layerview.attributes_at(view(spark, d, "units_a"), 100.0, 15.0)


@query("J14_neighbours", with_views("SELECT a.fid, count(*) AS n FROM units_a a JOIN units_a b ON a.fid <> b.fid AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin GROUP BY a.fid"))
def j14(spark, d):
    a = view(spark, d, "units_a").select("fid", *boxes.BOX)
    return boxes.box_join(a, a).where("a_fid <> b_fid").groupBy(F.col("a_fid").alias("fid")).agg(F.count(F.lit(1)).alias("n"))


@query("J15_within_distance", with_views("SELECT a.fid AS a_fid, b.fid AS b_fid FROM units_b a JOIN overlay b ON greatest(b.xmin - a.xmax, a.xmin - b.xmax, 0) * greatest(b.xmin - a.xmax, a.xmin - b.xmax, 0) + greatest(b.ymin - a.ymax, a.ymin - b.ymax, 0) * greatest(b.ymin - a.ymax, a.ymin - b.ymax, 0) <= 25"))
def j15(spark, d):
    pairs = boxes.box_join(view(spark, d, "units_b"), view(spark, d, "overlay"), pad=5.0)
    gap = lambda lo, hi: F.greatest(F.col(f"b_{lo}") - F.col(f"a_{hi}"), F.col(f"a_{lo}") - F.col(f"b_{hi}"), F.lit(0.0))
    x, y = gap("xmin", "xmax"), gap("ymin", "ymax")
    return pairs.where(x * x + y * y <= 25).select("a_fid", "b_fid")


@query("J20_nullsafe_writeback", with_views("WITH m AS (SELECT adm2_code AS o, adm1_code AS p, 'N' || row_number() OVER (ORDER BY adm1_code, adm2_code NULLS LAST) AS n FROM (SELECT DISTINCT adm1_code, adm2_code FROM hier) t) SELECT fid, adm1_code, n AS adm2_code FROM hier JOIN m ON m.o IS NOT DISTINCT FROM adm2_code AND m.p IS NOT DISTINCT FROM adm1_code"))
def j20(spark, d):
    h = view(spark, d, "hier").select("fid", "adm1_code", "adm2_code")
    number = F.row_number().over(Window.orderBy("adm1_code", F.asc_nulls_last("adm2_code")))  # a row for each unit of the level
    mapping = h.select("adm1_code", "adm2_code").distinct().select(F.col("adm2_code").alias("old"), F.col("adm1_code").alias("parent"), F.concat(F.lit("N"), number.cast("string")).alias("new"))
    return layerview.write_back(h, mapping, "adm2_code", "adm1_code")


@query("J21_flagged_units", with_views(r"SELECT DISTINCT p_partkey FROM part WHERE 'P' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') IN (SELECT code FROM names WHERE regexp_matches(name, '^ | $|  ') AND trim(name) <> '')"))
def j21(spark, d):
    units = table(spark, d, "part").select("p_partkey", F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("adm2_code"))
    from cadastra.shipping import ship

    ship(spark)
    return layerview.flagged_units(units, names.CHECKS["whitespace"](view(spark, d, "names")), {2: "adm2_code"}).select("p_partkey")


@query("P13_carry_columns", with_views("SELECT a.fid, o.code AS overlay_code, o.name AS overlay_name, o.fid AS overlay_fid FROM units_a a, (SELECT * FROM overlay ORDER BY fid LIMIT 1) o"))
def p13(spark, d):
    return layerview.carry(view(spark, d, "units_a").select("fid"), view(spark, d, "overlay").orderBy("fid").limit(1))


@query("P15_substring_filter", with_views("SELECT fid, name FROM units_a WHERE contains(lower(name), 'red') OR contains(lower(code), 'p1')"))
def p15(spark, d):
    held = lambda c, t: F.contains(F.lower(c), F.lit(t))
    return view(spark, d, "units_a").where(held("name", "red") | held("code", "p1")).select("fid", "name")


#: Fixed value: so many distinct codes a format report looks at.
SAMPLE_LIMIT = 10_000


@query("L04_sorted_sample", with_views(f"SELECT DISTINCT adm3_code FROM hier WHERE adm3_code IS NOT NULL ORDER BY adm3_code LIMIT {SAMPLE_LIMIT}"))
def l04(spark, d):
    return view(spark, d, "hier").where("adm3_code is not null").select("adm3_code").distinct().orderBy("adm3_code").limit(SAMPLE_LIMIT)


@query("C14_code_update")
def c14(spark, d):
    old, new, zones = (view(spark, d, n) for n in ("units_a", "units_b", "overlay"))
    zone = lambda layer: assign.best_overlap(boxes.overlap_pairs(layer, zones)).select(F.col("input_fid").alias("fid"), "overlay_fid").join(zones.select(F.col("fid").alias("overlay_fid"), F.col("code").alias("parent_code")).hint("merge"), "overlay_fid")
    number = F.row_number().over(Window.partitionBy("parent_code").orderBy("fid"))
    coded = stored(old.drop("code").hint("merge").join(zone(old), "fid").withColumn("code", F.concat("parent_code", F.lit("-"), codes.padded(number, 3))).drop("parent_code", "overlay_fid"))
    return update.update_level(coded, new, stored(zone(new)), codes.CodeFormat(delimiter="-", width=3))


@query("T05_one_per_country", with_views("SELECT iso, id FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY CASE status WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, created DESC, id) AS r FROM orders_work) t WHERE r = 1"))
def t05(spark, d):
    rank = status.rank_of(F.col("status"), ["O", "P", "F"])
    return status.latest(view(spark, d, "orders_work"), ["iso"], [rank.asc(), F.desc("created"), F.asc("id")]).select("iso", "id")


@query("T10_unit_counts", with_views("WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iso ORDER BY depth DESC, source) AS r FROM src_match) t WHERE r = 1) SELECT iso, units + matched AS total, CAST(sum(units + matched) OVER () AS BIGINT) AS grand_total FROM l"))
def t10(spark, d):
    last = status.latest(view(spark, d, "src_match"), ["iso"], [F.desc("depth"), F.asc("source")]).select("iso", (F.col("units") + F.col("matched")).alias("total"))
    return last.crossJoin(F.broadcast(last.agg(F.sum("total").alias("grand_total"))))  # one row


@query("T14_mismatches", with_views("SELECT iso, list_sort(list(source)) AS sources FROM src_match WHERE matched < units GROUP BY iso"))
def t14(spark, d):
    return view(spark, d, "src_match").where("matched < units").groupBy("iso").agg(F.array_sort(F.collect_list("source")).alias("sources"))


@query("C13_update_hierarchy")
def c13(spark, d):
    """Both levels of the zoned layer, carried over to its next version; tested on a small hierarchy."""
    out, _ = update.update_hierarchy(*_versions(spark, d), [1, 2], codes.CodeFormat("R", "-", [2, 4]))
    return out.select("fid", "adm1_code", "adm2_code", "predecessor_adm1_code", "predecessor_adm2_code")


@query("C15_update_changelog")
def c15(spark, d):
    return update.update_hierarchy(*_versions(spark, d), [1, 2], codes.CodeFormat("R", "-", [2, 4]))[1]


def _versions(spark, d):
    zone = F.floor(F.col("ymin") / 40)
    old = view(spark, d, "units_a").select("fid", F.concat(F.lit("R-"), codes.padded(zone + 1, 2)).alias("adm1_code"), F.col("name").alias("adm2_name"), *boxes.BOX)
    number = F.row_number().over(Window.partitionBy("adm1_code").orderBy("fid"))
    old = old.withColumn("adm2_code", F.concat("adm1_code", F.lit("-"), codes.padded(number, 4)))
    new = view(spark, d, "units_b").select("fid", zone.cast("string").alias("adm1_code"), F.col("code").alias("adm2_code"), F.col("name").alias("adm2_name"), *boxes.BOX)
    return old, new.dropDuplicates(["adm2_code"])


@query("T17_resolve_names", r"""WITH n AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN substr(n_name, 2, 4) WHEN 2 THEN ' ' || n_name || ' ' ELSE 'Name of ' || n_nationkey END AS name FROM nation)
    SELECT DISTINCT name, CASE WHEN lower(trim(name)) = 'name of 3' THEN 900 WHEN e.n_nationkey IS NOT NULL THEN e.n_nationkey ELSE (SELECT min(n_nationkey) FROM nation c WHERE list_bool_and(list_transform(regexp_split_to_array(lower(trim(name)), '\W+'), lambda w: contains(lower(c.n_name), w)))) END AS iso
    FROM n LEFT JOIN nation e ON lower(e.n_name) = lower(trim(name))""")
def t17(spark, d):
    """Nation names as spelt elsewhere: in other case, with spaces, a part of them, overridden, or unknown."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    spelt = F.when(k % 4 == 0, F.lower("n_name")).when(k % 4 == 1, F.substring("n_name", 2, 4)).when(k % 4 == 2, F.concat(F.lit(" "), "n_name", F.lit(" "))).otherwise(F.concat(F.lit("Name of "), k.cast("string")))
    return status.resolve_names(n.select(spelt.alias("name")).distinct(), n.select(F.col("n_name").alias("country"), k.alias("iso")), {"name of 3": 900})


@query("T19_key_value_labels", r"""SELECT event_id, string_split(label, ':')[1] AS key, trim(string_split(label, ':')[2]) AS value FROM (SELECT event_id, unnest(string_split(event_type || ': ' || (user_id % 7) || ';bad' || (event_id % 3) || ';' || CASE event_id % 3 WHEN 0 THEN 'k:' WHEN 1 THEN ': v' ELSE 'K2:x y' END, ';')) AS label FROM events) t
    WHERE regexp_matches(label, '^[a-z][a-z_]*: *[^ ]')""")
def t19(spark, d):
    """Labels key: value of an event, those that are well formed: a lower-case key and a value."""
    k = F.col("event_id") % 3
    last = F.when(k == 0, "k:").when(k == 1, ": v").otherwise("K2:x y")
    text = F.concat("event_type", F.lit(": "), (F.col("user_id") % 7).cast("string"), F.lit(";bad"), k.cast("string"), F.lit(";"), last)
    each = table(spark, d, "events").select("event_id", F.explode(F.split(text, ";")).alias("label"))
    return status.key_values(each, "label").select("event_id", "key", "value")


@query("T22_country_order", with_views("SELECT iso, n, row_number() OVER (ORDER BY CASE best WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, n DESC, iso) AS place FROM (SELECT iso, count(*) AS n, min(priority) AS best FROM orders_work GROUP BY iso) t"))
def t22(spark, d):
    per = view(spark, d, "orders_work").groupBy("iso").agg(F.count(F.lit(1)).alias("n"), F.min("priority").alias("best"))
    place = F.row_number().over(Window.orderBy(status.rank_of(F.col("best"), ["1-URGENT", "2-HIGH"]), F.desc("n"), "iso"))  # a row for each country
    return per.select("iso", "n", place.cast("long").alias("place"))
