"""Checks and safe fixes of unit names.

The input is a level-unit table: level, name_column, name_index, code_column,
code, parent_code, name, row_count. A finding is (kind, level, name_column,
code_a, name_a, code_b, name_b, suggested, reason).

Rules about one name are tried together in a single projection over the units,
which yields an array of findings for each; rules about several names of one
parent are aggregations of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.text import INVISIBLE, MOJIBAKE, ODD_SPACE, STRONG_MOJIBAKE, clean_name, name_forms
from cadastra.shipping import ship
from cadastra.storage import stored

# Fixed values of the checks.
PLACEHOLDERS = ["n/a", "n_a", "n.a.", "null", "none", "unknown", "undefined"]
SIBLING_FILLED, MIXED_CASE, LONG_WORD, SHORT_WORD, LEAST_CODE = 0.9, 0.9, 6, 3, 3
ROLLUP_SHARE, ROLLUP_ROWS = 0.5, 5
ERRORS = ["check-failed", "blank-name", "placeholder-name", "encoding-artifact"]
PER_NAME = ["blank-name", "placeholder-name", "encoding-artifact", "invisible-character", "unnormalized-unicode", "whitespace", "mixed-script", "code-in-name"]
FIXED = ["whitespace", "invisible-character", "unnormalized-unicode", "encoding-artifact"]
SCRIPTS = ["Latin", "Cyrillic", "Greek"]
ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
COLUMNS = ["kind", "level", "name_column", "code_a", "name_a", "code_b", "name_b", "suggested", "reason"]

UNSEEN = f"{INVISIBLE}|{ODD_SPACE}"
#: A word that holds letters of one script and later of another.
TWO_SCRIPTS = "|".join(rf"\p{{Is{a}}}[\p{{L}}\p{{M}}]*[{''.join(rf'\p{{Is{b}}}' for b in SCRIPTS if b != a)}]" for a in SCRIPTS)
#: A letter of a script without the three scripts' cases.
OTHER_SCRIPT = rf"[\p{{L}}&&[^{''.join(rf'\p{{Is{s}}}' for s in SCRIPTS)}]]"


def empty(name: Column) -> Column:
    """Nothing to be seen: null, or only spaces and invisible characters."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), f"{UNSEEN}| ", "") == ""


def _describe(units: DataFrame) -> DataFrame:
    """Coded units with what the rules ask of a name: whether it is empty, its case, and its forms."""
    text = F.col("name")
    has_upper, has_lower = text.rlike(r"\p{Lu}"), text.rlike(r"\p{Ll}")
    words = F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.rlike(ROMAN) & (w != F.lower(w))), F.length)
    loud = F.exists(words, lambda n: n >= LONG_WORD) | (F.size(F.filter(words, lambda n: n >= SHORT_WORD)) > 1)
    sized = text.rlike(rf"\p{{L}}{{{SHORT_WORD + 1}}}")
    case = F.when(text.rlike(OTHER_SCRIPT), None).when(has_upper & has_lower, "mixed").when(has_upper & sized & loud, "upper").when(has_lower & ~has_upper & sized, "lower")
    df = units.where(F.col("code").isNotNull()).withColumns({"empty": empty(text), "case": case})
    return df.withColumn("forms", F.when(~F.col("empty"), name_forms(text)))


def _column_shares(df: DataFrame) -> DataFrame:
    """For each level and name column: the share of names that are not empty, and of mixed case among those with a case."""
    return df.groupBy("level", "name_column").agg(F.avg((~F.col("empty")).cast("int")).alias("filled"), F.avg(F.when(~F.col("empty"), (F.col("case") == "mixed").cast("int"))).alias("mixed"))


def _spaced(text: Column) -> Column:
    """The runs of letters and digits in lower case, each between single spaces."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))


def _mentions(code: str) -> Column:
    """The name holds the whole code, if that is long enough and has a letter and a digit."""
    own = F.col(code)
    return F.coalesce((F.length(own) >= LEAST_CODE) & own.rlike(r"\p{L}") & own.rlike(r"\p{N}") & F.contains(_spaced(F.col("name")), _spaced(own)), F.lit(False))


#: Rules about one name: kind: (condition, reason, suggestion). Only the first is about empty names.
RULES: dict[str, Callable[[], tuple[Column, Column, Column | None]]] = {
    "blank-name": lambda: (F.col("empty") & ((F.col("name_index") == 0) | (F.col("filled") >= SIBLING_FILLED)), F.lit("the name is empty"), None),
    "placeholder-name": lambda: (
        F.lower(F.trim("name")).isin(PLACEHOLDERS) | (F.lower(F.trim("name")) == F.lower("code")) | ~F.col("name").rlike(r"[\p{L}\p{N}]"), F.lit("stands in for a missing name"), None),
    "encoding-artifact": lambda: (
        F.contains("name", F.lit("�")) | F.col("name").rlike(STRONG_MOJIBAKE) | (F.col("name").rlike(MOJIBAKE) & F.col("forms.repaired").isNotNull()),
        F.when(F.contains("name", F.lit("�")), "some characters were lost on reading").when(F.col("forms.repaired").isNull(), "decoded wrongly; can't be repaired safely").otherwise("decoded wrongly; can be repaired"), F.col("forms.repaired")),
    "invisible-character": lambda: (F.col("name").rlike(UNSEEN), F.lit("holds characters that can't be seen"), F.col("forms.cleaned")),
    "unnormalized-unicode": lambda: (F.length("forms.composed") < F.length("name"), F.lit("letters and accents are not composed"), F.col("forms.cleaned")),
    "whitespace": lambda: (F.col("name").startswith(" ") | F.col("name").endswith(" ") | F.contains("name", F.lit("  ")), F.lit("spaces at an end, or doubled"), F.col("forms.cleaned")),
    "case-outlier": lambda: (
        F.col("case").isin("upper", "lower") & (F.col("mixed") >= MIXED_CASE), F.concat(F.lit("the column is in mixed case, this name in "), "case", F.lit(" case")), None),
    "mixed-script": lambda: (F.col("name").rlike(TWO_SCRIPTS), F.lit("letters of several scripts in one word"), None),
    "code-in-name": lambda: ((F.lower(F.trim("name")) != F.lower("code")) & (_mentions("code") | _mentions("parent_code")), F.lit("holds its own code or its parent's"), None),
}


def single_findings(units: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Findings of the rules about one name, in one pass; equal findings count once."""
    df = _describe(units)
    df = df.join(_column_shares(df), ["level", "name_column"])
    null, tried = F.lit(None).cast("string"), []
    for kind in kinds or list(RULES):
        condition, reason, suggested = RULES[kind]()
        condition = condition if kind == "blank-name" else ~F.col("empty") & condition
        tried.append(F.when(condition, F.struct(F.lit(kind).alias("kind"), (null if suggested is None else suggested).alias("suggested"), reason.alias("reason"))))
    each = df.select("level", "name_column", "code", "name", F.explode(F.array_compact(F.array(*tried))).alias("f"))
    return each.select("f.kind", "level", "name_column", F.col("code").alias("code_a"), F.col("name").alias("name_a"), null.alias("code_b"), null.alias("name_b"), "f.suggested", "f.reason").distinct()


def _shared(units: DataFrame, key: str, kind: str, reason: Column, allowed: Column) -> DataFrame:
    """Findings of units of one parent that share a key; of several name columns with the same units the first counts."""
    groups = units.groupBy("level", "name_column", "name_index", "parent_code", key).agg(
        F.array_sort(F.collect_set(F.struct("code", "name"))).alias("held"), F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("name")).alias("spellings"), allowed.alias("allowed"))
    groups = groups.where((F.size("codes") > 1) & F.col("allowed"))
    first = groups.groupBy("level", "codes").agg(F.min("name_index").alias("name_index"))
    hit = groups.join(first, ["level", "codes", "name_index"])
    pick = lambda i, c: F.col("held")[i][c]
    return hit.select(F.lit(kind).alias("kind"), "level", "name_column", pick(0, "code").alias("code_a"), pick(0, "name").alias("name_a"), pick(1, "code").alias("code_b"), pick(1, "name").alias("name_b"), F.lit(None).cast("string").alias("suggested"), reason.alias("reason"))


def duplicate(units: DataFrame) -> DataFrame:
    """One name for several units of one parent."""
    named = units.where(F.col("code").isNotNull() & ~empty(F.col("name"))).withColumn("same", F.col("name"))
    where = F.coalesce(F.concat(F.lit("parent "), "parent_code"), F.lit("the whole table"))
    return _shared(named, "same", "duplicate-name", F.concat(F.lit("also the name of "), (F.size("codes") - 1).cast("string"), F.lit(" more in "), where), F.lit(True))


def normalized_duplicate(units: DataFrame) -> DataFrame:
    """Several names of one parent that differ in case, separators or, next to an unaccented spelling, accents alone."""
    df = _describe(units).where(~F.col("empty")).select("level", "name_column", "name_index", "parent_code", "code", "name", "forms.*").where("loose <> ''")
    allowed = (F.count_distinct("name") > 1) & ((F.count_distinct("key") == 1) | F.bool_or("plain"))
    return _shared(df, "loose", "normalized-duplicate-name", F.concat(F.lit("differ in spelling only: "), F.array_join("spellings", " / ")), allowed)


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {kind: (lambda units, kind=kind: single_findings(units, [kind])) for kind in RULES}
CHECKS |= {"duplicate-name": duplicate, "normalized-duplicate-name": normalized_duplicate}


def _tried(units: DataFrame, check: Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
    """What a check finds, stored, so that one that fails as it runs is a finding and hides no other."""
    try:
        return stored(check(units).select(*COLUMNS))
    except Exception as e:
        null = [F.lit(None).cast("int" if c == "level" else "string").alias(c) for c in COLUMNS[1:-1]]
        return units.sparkSession.range(1).select(F.lit("check-failed").alias("kind"), *null, F.lit(f"{kind} could not run: {e}"[:500]).alias("reason"))


def _single_at_once(units: DataFrame) -> list[DataFrame]:
    """The rules about one name in one pass, or one by one if that pass fails."""
    try:
        return [stored(single_findings(units).select(*COLUMNS))]
    except Exception:
        return [_tried(units, CHECKS[kind], kind) for kind in RULES]


def run_checks(units: DataFrame) -> DataFrame:
    """All findings. An empty name has no other finding of its own, a misread one none of invisible characters."""
    ship(units.sparkSession)
    single = reduce(DataFrame.unionByName, _single_at_once(units))
    own = Window.partitionBy("level", "name_column", "code_a")
    has = lambda kind: F.coalesce(F.bool_or(F.col("kind") == kind).over(own), F.lit(False))
    explained = (has("blank-name") & ~F.col("kind").isin("blank-name", "check-failed")) | (has("encoding-artifact") & (F.col("kind") == "invisible-character"))
    single = single.withColumn("explained", explained).where("not explained").select(*COLUMNS)
    return reduce(DataFrame.unionByName, [single, *(_tried(units, CHECKS[k], k) for k in ("duplicate-name", "normalized-duplicate-name"))])


def report(found: DataFrame, units: DataFrame) -> DataFrame:
    """Findings with key (kind-number) and severity.

    A kind that hits over half of a column's rows, and five at least, is one row
    for the column; a unit that is blank in several columns is one row.
    """
    column = ["level", "name_column"]
    found = stored(found)
    total = units.groupBy(*column).agg(F.count(F.lit(1)).alias("total"))
    hits = found.where(F.col("kind").isin(PER_NAME)).groupBy("kind", *column).agg(F.count(F.lit(1)).alias("hits"), F.min("reason").alias("why"))
    wide = hits.join(total, column).where((F.col("hits") >= ROLLUP_ROWS) & (F.col("hits") > F.col("total") * ROLLUP_SHARE))
    null = lambda c: F.lit(None).cast("string").alias(c)
    rolled = wide.select("kind", *column, *map(null, COLUMNS[3:-1]), F.concat(F.col("hits").cast("string"), F.lit(" of the "), F.col("total").cast("string"), F.lit(" names of the column: "), "why").alias("reason"))
    left = found.join(wide.select("kind", *column), ["kind", *column], "left_anti").select(*COLUMNS)
    blank = left.where("kind = 'blank-name' and code_a is not null")
    blank = blank.groupBy("kind", "level", "code_a").agg(F.array_join(F.array_sort(F.collect_list("name_column")), ", ").alias("name_column"), F.min("reason").alias("reason"))
    blank = blank.select("kind", "level", "name_column", "code_a", *map(null, COLUMNS[4:-1]), "reason")
    rows = left.where("kind <> 'blank-name' or code_a is null").unionByName(blank).unionByName(rolled)
    order = Window.partitionBy("kind").orderBy(*[F.col(c).asc_nulls_last() for c in (*column, "code_a", "name_a", "code_b", "reason")])
    return rows.select(F.concat("kind", F.lit("-"), F.row_number().over(order).cast("string")).alias("key"), *COLUMNS, F.when(F.col("kind").isin(ERRORS), "error").otherwise("warn").alias("severity"))


def apply_fixes(units: DataFrame, found: DataFrame) -> DataFrame:
    """Units with the names of fixable findings rewritten, unless the fix would empty them, and a fixed flag."""
    flagged = found.where(F.col("kind").isin(FIXED)).select("level", "name_column", F.col("code_a").alias("code"), F.lit(True).alias("flagged")).distinct()
    df = units.join(flagged, ["level", "name_column", "code"], "left").withColumn("cleaned", clean_name("name"))
    fixed = F.coalesce(F.col("flagged") & (F.col("cleaned") != "") & (F.col("cleaned") != F.col("name")), F.lit(False))
    return df.withColumn("fixed", fixed).withColumn("name", F.when(F.col("fixed"), F.col("cleaned")).otherwise(F.col("name"))).select(*units.columns, "fixed")
