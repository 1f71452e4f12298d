"""Derived views: layers and hierarchies made of the provided tables.

The texts run in Spark and in the SQL oracle alike, so the inputs of a query
and of its equivalent can't drift. Boxes lie on a grid of 10 x 10 cells, 40 to
a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_GRID = "SELECT p_partkey AS k, p_name, p_size, CAST((p_partkey % 40) * 10 AS DOUBLE) AS x, CAST(CAST(floor(p_partkey / 40.0) AS BIGINT) * 10 AS DOUBLE) AS y FROM part"

VIEWS = {
    "units_a": f"""
        SELECT k AS fid, 'P' || k AS code, p_name AS name, x AS xmin, y AS ymin, x + 10 AS xmax, y + 10 AS ymax FROM ({_GRID}) g WHERE k % 31 <> 2""",
    "units_b": f"""
        SELECT k * 2 AS fid, CASE WHEN k % 29 = 1 THEN 'Q' || k ELSE 'P' || k END AS code,
               CASE WHEN k % 23 = 3 THEN 'new ' || p_name ELSE p_name END AS name,
               CASE WHEN k % 13 = 5 THEN x + 3 ELSE x END AS xmin, y AS ymin,
               CASE WHEN k % 11 = 4 AND k % 40 < 39 THEN x + 20 WHEN k % 13 = 5 THEN x + 13 WHEN k % 19 = 7 THEN x + 5 ELSE x + 10 END AS xmax, y + 10 AS ymax
        FROM ({_GRID}) g WHERE k % 17 <> 0 AND NOT (k % 11 = 5 AND k % 40 > 0)
        UNION ALL
        SELECT k * 2 + 1, 'P' || k || 'b', p_name, x + 5, y, x + 10, y + 10 FROM ({_GRID}) h WHERE k % 19 = 7 AND k % 13 <> 5 AND k % 11 <> 4 AND k % 17 <> 0 AND NOT (k % 11 = 5 AND k % 40 > 0)""",
    "overlay": f"""
        SELECT cx + cy * 10 AS fid, 'C' || (cx + cy * 10) AS code, 'zone ' || cx || '-' || cy AS name,
               CAST(cx * 40 + 5 AS DOUBLE) AS xmin, CAST(cy * 40 AS DOUBLE) AS ymin, CAST(cx * 40 + 45 AS DOUBLE) AS xmax, CAST(cy * 40 + 38 AS DOUBLE) AS ymax
        FROM (SELECT DISTINCT CAST(floor(x / 40) AS BIGINT) AS cx, CAST(floor(y / 40) AS BIGINT) AS cy FROM ({_GRID}) g) c WHERE (cx + cy * 10) % 7 <> 3""",
    "hier": """
        SELECT c_custkey AS fid, 'R' || r_regionkey AS adm1_code, r_name AS adm1_name,
               CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE 'R' || r_regionkey || '-' || lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0') END AS adm2_code,
               CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE n_name END AS adm2_name,
               CASE WHEN c_custkey % 37 = 0 OR c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 101 = 7 THEN 'X-' || c_custkey
                    ELSE 'R' || r_regionkey || '-' || lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0') || '-' || lpad(CAST(c_custkey % 400 AS VARCHAR(9)), 4, '0') END AS adm3_code,
               CASE WHEN c_custkey % 43 = 1 THEN NULL ELSE c_mktsegment || ' ' || (c_custkey % 400) END AS adm3_name,
               c_mktsegment AS segment, CAST(floor(c_acctbal) AS BIGINT) AS balance
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "names": """
        SELECT 2 AS level, 'adm2_name' AS name_column, 0 AS name_index, 'adm2_code' AS code_column, 'P' || lpad(CAST(p_partkey AS VARCHAR(9)), 6, '0') AS code, 'B' || p_size AS parent_code,
               CASE p_partkey % 60 WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN 'N/A' WHEN 4 THEN 'P' || lpad(CAST(p_partkey AS VARCHAR(9)), 6, '0') WHEN 5 THEN '---'
                    WHEN 6 THEN p_name || '​' WHEN 7 THEN p_name || '�' WHEN 8 THEN upper(p_name) || ' WITHOUT' WHEN 9 THEN ' ' || p_name || '  x'
                    WHEN 10 THEN replace(p_name, 'a', 'а') || ' aа' WHEN 11 THEN p_name || ' P' || lpad(CAST(p_partkey AS VARCHAR(9)), 6, '0') WHEN 12 THEN p_name || ' é'
                    WHEN 13 THEN p_name || ' Ã©t' WHEN 14 THEN upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' ELSE upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || (p_partkey % 9) END AS name,
               CAST(1 AS BIGINT) AS row_count
        FROM part
        UNION ALL
        SELECT 1, 'adm1_name', 0, 'adm1_code', 'N' || n_nationkey, CAST(NULL AS VARCHAR(9)), n_name, CAST(n_regionkey AS BIGINT) + 1 FROM nation""",
    "orders_work": """
        SELECT o_orderkey AS id, n_name AS country, n_nationkey AS iso, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS created, CAST(round(o_totalprice) AS BIGINT) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "src_match": """
        SELECT l_suppkey AS iso, l_linenumber AS source, CAST(count(*) AS BIGINT) AS units, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(max(l_quantity) AS BIGINT) AS depth
        FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "people": """
        SELECT CAST(l_suppkey % 50 AS BIGINT) AS unit, CAST(year(l_shipdate) AS BIGINT) AS year,
               CASE l_linenumber WHEN 1 THEN 'T_TL' WHEN 2 THEN 'M_TL' WHEN 3 THEN 'F_TL' WHEN 4 THEN 'T_00_04' WHEN 5 THEN 'T_05_09' ELSE 'T_10_14' END AS grp, CAST(sum(l_quantity) AS DOUBLE) AS people
        FROM lineitem GROUP BY 1, 2, 3""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables of sf_dir."""
    text = VIEWS[name].replace("VARCHAR(9)", "STRING")
    for t in ("part", "customer", "nation", "region", "orders", "lineitem"):
        text = re.sub(rf"(?<=FROM ){t}\b|(?<=JOIN ){t}\b", f"parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """Oracle SQL over the derived views that it names."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n].replace('VARCHAR(9)', 'VARCHAR')})" for n in used)
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].lstrip()}"
    if re.match(r"WITH\b", body):
        return f"WITH {ctes}, {body[4:].lstrip()}"
    return f"WITH {ctes} {body}"
