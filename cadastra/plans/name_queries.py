"""Queries over unit names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.text import INVISIBLE, ODD_SPACE, STRONG_MOJIBAKE, clean_name, visible_name
from cadastra.operators import names
from cadastra.plans.views import view, with_views
from cadastra.registry import query
from cadastra.shipping import ship

_NAMED = f"named AS (SELECT * FROM names WHERE code IS NOT NULL AND length(regexp_replace(coalesce(name, ''), '{INVISIBLE}|{ODD_SPACE}| ', '', 'g')) > 0)"
_KEYS = "level, name_column, code AS code_a, name AS name_a"


def _runs(text: str) -> str:
    return rf"(' ' || coalesce(list_aggregate(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), 'string_agg', ' '), '') || ' ')"


def _mentions(code: str) -> str:
    return rf"coalesce(length({code}) > 2 AND regexp_matches({code}, '\p{{L}}') AND regexp_matches({code}, '\p{{N}}') AND position({_runs(code)} IN {_runs('name')}) > 0, false)"


def _short(found: DataFrame, *more: str) -> DataFrame:
    return found.select("level", "name_column", "code_a", "name_a", *more)


def _check(kind: str, *more: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return _short(names.CHECKS[kind](view(spark, d, "names")), *more)

    return run


_SUGGESTED = r"trim(regexp_replace(nfc_normalize(regexp_replace(regexp_replace(name, '" + ODD_SPACE + r"', ' ', 'g'), '" + INVISIBLE + r"', '', 'g')), ' {2,}', ' ', 'g'), ' ')"
_WORDS = rf"list_filter(regexp_extract_all(name, '\p{{L}}+'), lambda w: w <> lower(w) AND NOT regexp_matches(w, '{names.ROMAN}'))"
_CASES = rf"""cased AS (
    SELECT *, CASE
        WHEN regexp_matches(regexp_replace(name, '[\p{{Latin}}\p{{Cyrillic}}\p{{Greek}}]', '', 'g'), '\p{{L}}') THEN NULL
        WHEN regexp_matches(name, '\p{{Lu}}') AND regexp_matches(name, '\p{{Ll}}') THEN 'mixed'
        WHEN NOT regexp_matches(name, '\p{{L}}{{4}}') THEN NULL
        WHEN regexp_matches(name, '\p{{Ll}}') THEN 'lower'
        WHEN regexp_matches(name, '\p{{Lu}}') AND (len(list_filter({_WORDS}, lambda w: length(w) >= 6)) > 0 OR len(list_filter({_WORDS}, lambda w: length(w) >= 3)) > 1) THEN 'upper' END AS letter_case
    FROM named)"""
_SQL = {
    "N01_blank": ("blank-name", f"SELECT DISTINCT {_KEYS} FROM names u WHERE code IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT regexp_replace(u.name, '{INVISIBLE}|{ODD_SPACE}| ', '', 'g') AS rest) r WHERE rest <> '')", ()),
    "N02_placeholder": ("placeholder-name", rf"WITH {_NAMED} SELECT DISTINCT {_KEYS} FROM named WHERE lower(trim(name)) IN ({', '.join(repr(x) for x in names.PLACEHOLDERS)}, lower(code)) OR NOT regexp_matches(name, '[\p{{L}}\p{{N}}]')", ()),
    "N03_duplicate": ("duplicate-name", f"WITH {_NAMED}, pairs AS (SELECT DISTINCT level, name_column, parent_code, name, code FROM named), ranked AS (SELECT *, dense_rank() OVER (PARTITION BY level, name_column, parent_code, name ORDER BY code) AS r FROM pairs) SELECT a.level, a.name_column, a.code AS code_a, a.name AS name_a, b.code AS code_b FROM ranked a JOIN ranked b ON a.level = b.level AND a.name_column = b.name_column AND a.parent_code IS NOT DISTINCT FROM b.parent_code AND a.name = b.name WHERE a.r = 1 AND b.r = 2", ("code_b",)),
    "N06_encoding": ("encoding-artifact", f"WITH {_NAMED} SELECT DISTINCT {_KEYS} FROM named WHERE regexp_matches(name, '�|{STRONG_MOJIBAKE}')", ()),
    "N07_invisible": ("invisible-character", f"WITH {_NAMED} SELECT DISTINCT {_KEYS}, {_SUGGESTED} AS suggested FROM named WHERE regexp_matches(name, '{INVISIBLE}|{ODD_SPACE}')", ("suggested",)),
    "N07_unnormalized": ("unnormalized-unicode", f"WITH {_NAMED} SELECT DISTINCT {_KEYS}, {_SUGGESTED} AS suggested FROM named WHERE length(nfc_normalize(name)) < length(name)", ("suggested",)),
    "N07_whitespace": ("whitespace", f"WITH {_NAMED} SELECT DISTINCT {_KEYS} FROM named WHERE name <> trim(regexp_replace(name, ' +', ' ', 'g'), ' ')", ()),
    "N09_mixed_script": ("mixed-script", rf"WITH {_NAMED}, w AS (SELECT *, unnest(regexp_extract_all(name, '[\p{{L}}\p{{M}}]+')) AS w FROM named) SELECT DISTINCT {_KEYS} FROM w WHERE " + r" OR ".join(rf"(regexp_matches(w, '\p{{{a}}}') AND regexp_matches(w, '\p{{{b}}}'))" for a, b in (("Latin", "Cyrillic"), ("Latin", "Greek"), ("Cyrillic", "Greek"))), ()),
    "N10_code_in_name": ("code-in-name", f"WITH {_NAMED} SELECT DISTINCT {_KEYS} FROM named WHERE lower(trim(name)) <> lower(code) AND ({_mentions('code')} OR {_mentions('parent_code')})", ()),
    "N08_case_outlier": ("case-outlier", f"WITH {_NAMED}, {_CASES} SELECT DISTINCT {_KEYS} FROM cased o WHERE letter_case <> 'mixed' AND (SELECT count(*) FILTER (WHERE letter_case = 'mixed') / count(letter_case) FROM cased c WHERE c.level = o.level AND c.name_column = o.name_column) >= 0.9", ()),
}
for _name, (_kind, _sql, _more) in _SQL.items():
    query(_name, with_views(_sql))(_check(_kind, *_more))


def _skeleton(text: str) -> str:
    """Letters and digits alone; separators between letters go (the pattern takes a letter, so one-letter words need it twice)."""
    joined = text
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '([\p{{L}}\p{{M}}])[^\p{{L}}\p{{M}}\p{{N}}]+(\p{{L}})', '\1\2', 'g')"
    return rf"trim(regexp_replace({joined}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


@query("N04_normalized_duplicate", with_views(rf"""WITH {_NAMED}, keyed AS (SELECT level, name_column, parent_code, code, name, {_skeleton('nfc_normalize(lower(nfc_normalize(name)))')} AS strict,
        CASE WHEN regexp_matches(regexp_replace(name, '\p{{Latin}}', '', 'g'), '\p{{L}}') THEN {_skeleton('nfc_normalize(lower(nfc_normalize(name)))')} ELSE {_skeleton('lower(strip_accents(name))')} END AS loose, strip_accents(name) = name AS plain FROM named),
    grouped AS (SELECT level, name_column, list_sort(list(DISTINCT [code, name])) AS held FROM keyed WHERE loose <> '' GROUP BY level, name_column, parent_code, loose HAVING count(DISTINCT code) > 1 AND count(DISTINCT name) > 1 AND (count(DISTINCT strict) = 1 OR bool_or(plain)))
    SELECT level, name_column, held[1][1] AS code_a, held[1][2] AS name_a, held[2][1] AS code_b, held[2][2] AS name_b FROM grouped"""))
def n04(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _short(names.normalized_duplicate(view(spark, d, "names")), "code_b", "name_b")


@query("N05_report")
def n05(spark: SparkSession, d: str) -> DataFrame:
    units = view(spark, d, "names")
    return names.report(names.run_checks(units), units)


@query("N11_check_runner")
def n11(spark: SparkSession, d: str) -> DataFrame:
    return names.run_checks(view(spark, d, "names"))


@query("N12_name_clean")
def n12(spark: SparkSession, d: str) -> DataFrame:
    units = view(spark, d, "names")
    return names.apply_fixes(units, names.run_checks(units))


@query("N13_visible_names", with_views(f"WITH m AS (SELECT DISTINCT name FROM names WHERE regexp_matches(name, '{INVISIBLE}|{ODD_SPACE}')), c AS (SELECT name, unnest(string_split(name, '')) AS c, generate_subscripts(string_split(name, ''), 1) AS i FROM m) SELECT name, string_agg(CASE WHEN regexp_matches(c, '{INVISIBLE}|{ODD_SPACE}') THEN '<U+' || lpad(printf('%X', unicode(c)), 4, '0') || '>' ELSE c END, '' ORDER BY i) AS shown FROM c GROUP BY name"))
def n13(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return view(spark, d, "names").where(F.col("name").rlike(f"{INVISIBLE}|{ODD_SPACE}")).select("name", visible_name("name").alias("shown")).distinct()


@query("U01f_clean_text")
def u01f(spark: SparkSession, d: str) -> DataFrame:
    """Every document cleaned. SQL lacks the repair step; tests compare with plain Python."""
    ship(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", clean_name("text").alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))
