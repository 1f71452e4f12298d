"""Levels of an administrative hierarchy among the columns of a table.

Names are matched to templates such as "adm{n}_code" on the driver; what the
values say comes from one aggregation for each level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import hierarchy

CODE, NAME = "adm{n}_code", "adm{n}_name"
# Patterns that name a code or a name column, in order of preference.
CODE_COLUMNS = ["^(gid|fid)$", "^(geoid|pcode|adm[0-9]?_?pcode|p_code|iso3?|iso_a[23])$", "^(fips|hasc|adm_code)$", "^(code|id)$", "code$"]
NAME_COLUMNS = ["^name$", "^(.*_name|name_.*)$", "^(label|title|display.*|short.*name|long.*name)$", "^adm[0-9]?_?(en|name)$"]
# Severities, and the share of a level's units that a column of its cluster may merge.
SCHEMA_ERRORS = ["check-failed", "levels-undetected", "level-skipped", "multiple-parents", "orphan-child"]
MOST_MERGED = 0.3


def guess_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The likeliest code and name column: the first column of the first pattern that has any."""
    own = [c for c in columns if c != "fid"]
    return tuple(next((c for p in patterns for c in own if re.search(p, c, re.I)), None) for patterns in (CODE_COLUMNS, NAME_COLUMNS))


def at_level(template: str, n: int) -> str:
    return template.replace("{n}", str(n))


def level_of(column: str, template: str) -> int | None:
    """The level if column is the template's own name at some level."""
    head, tail = template.split("{n}")
    m = re.fullmatch(rf"{re.escape(head)}(\d+){re.escape(tail)}", column)
    return int(m[1]) if m else None


def template_levels(columns: list[str], code: str = CODE, name: str = NAME, *, require_codes: bool = True) -> list[int]:
    """Levels 1 to the deepest one that a column starts to name, and 0 if it has a code.

    Each needs its code column, or without require_codes a name column.
    """
    head = code.split("{n}")[0]
    deepest = max((int(m[1]) for c in columns if (m := re.match(rf"{re.escape(head)}(\d+)", c))), default=0)
    if deepest < 1:
        raise ValueError(f"no column names a level as {code}")
    good = lambda n: at_level(code, n) in columns or (not require_codes and at_level(name, n) in columns)
    lacking = [at_level(code, n) for n in range(1, deepest + 1) if not good(n)]
    if lacking:
        raise ValueError(f"levels without a code column: {', '.join(lacking)}")
    return [0] * (at_level(code, 0) in columns) + list(range(1, deepest + 1))


def families(columns: list[str], levels: Iterable[int], *templates: str) -> dict[str, dict[int, str]]:
    """Columns that start as a template does, by what follows the level: {"adm{n}_type": {1: "adm1_type", ...}}."""
    out: dict[str, dict[int, str]] = {}
    for head in dict.fromkeys(t.split("{n}")[0] for t in templates):
        for c in columns:
            m = re.fullmatch(rf"{re.escape(head)}(\d+)(.*)", c, re.S)
            if m and int(m[1]) in set(levels):
                out.setdefault(f"{head}{{n}}{m[2]}", {})[int(m[1])] = c
    return out


def sibling(column: str, k: int) -> str:
    """The k-th further column of a kind: adm2_name1, but GID_2_1."""
    return f"{column}{'_' if column[-1:].isdigit() else ''}{k}"


def free_sibling(column: str, taken: Iterable[str]) -> str:
    used, k = set(taken), 1
    while sibling(column, k) in used:
        k += 1
    return sibling(column, k)


def misordered(columns: list[str]) -> list[str]:
    """Columns whose siblings do not follow them in the order of their numbers."""
    at = {c: i for i, c in enumerate(columns)}
    runs = {c: [at[x] for x in (c, *(sibling(c, k) for k in range(1, len(columns) + 1))) if x in at] for c in columns}
    return [c for c in columns if runs[c] != sorted(runs[c])]


def canonical_order(columns: list[str], code: str = CODE, name: str = NAME) -> tuple[list[str], str | None]:
    """Columns deepest level first (names, others, codes), the rest behind; and the deepest code column, to sort rows by."""

    def place(template: str, c: str) -> tuple[int, int] | None:
        head, _, tail = template.partition("{n}")
        m = re.fullmatch(rf"{re.escape(head)}(\d+){re.escape(tail)}(?:{'_' if not tail or tail[-1].isdigit() else ''}(\d+))?", c)
        return (int(m[1]), int(m[2] or 0)) if m else None

    known = {c: (-p[0], kind, p[1]) for c in columns for kind, p in ((2, place(code, c)), (0, place(name, c))) if p}
    known = {c: (-p[0], 2, p[1]) if (p := place(code, c)) else v for c, v in known.items()}
    head = code.split("{n}")[0]
    for i, c in enumerate(columns):
        m = re.match(rf"{re.escape(head)}(\d+)", c) if head else None
        if c not in known and m and any(v[0] == -int(m[1]) for v in known.values()):
            known[c] = (-int(m[1]), 1, i)
    own = [n for c in known if (n := level_of(c, code)) is not None]
    return sorted(known, key=known.__getitem__) + [c for c in columns if c not in known], at_level(code, max(own)) if own else None


def finer_columns(columns: list[str], group_by: list[str], code: str = CODE, name: str = NAME) -> list[str]:
    """Columns of levels below the one that group_by names: a dissolve to that level drops them."""
    levels = template_levels(columns, code, name)
    target = max((n for n in levels if at_level(code, n) in group_by or at_level(name, n) in group_by), default=None)
    if target is None:
        raise ValueError(f"no level among {', '.join(group_by)}")
    below = families(columns, [n for n in levels if n > target], code)
    return [c for c in columns if any(c in per.values() for per in below.values())]


# Structure: levels that the values show.


@dataclass(frozen=True)
class Naming:
    """How a level's columns are named: before the level, the level, after it."""

    head: str
    level: str
    tail: str

    def fits(self, column: str) -> bool:
        return column.startswith(self.head + self.level) or column.endswith(self.level + self.tail)

    def kind(self, column: str) -> str:
        """What a fitting column is called without its level."""
        return column[len(self.head + self.level) :] if column.startswith(self.head + self.level) else column[: len(column) - len(self.level + self.tail)]


@dataclass
class LevelColumns:
    """The columns of one level; group_by holds those that name its units."""

    columns: list[str]
    group_by: list[str]
    code: str | None
    name: str | None
    has_code: bool
    naming: Naming | None = None
    kinds: dict[str, str] = field(default_factory=dict)


def _shared(names: list[str]) -> tuple[str, str]:
    """The longest start, and then end, that all names have."""
    head = names[0][: next((i for i, cs in enumerate(zip(*names)) if len(set(cs)) > 1), min(map(len, names)))]
    rest = [n[len(head) :][::-1] for n in names]
    tail = rest[0][: next((i for i, cs in enumerate(zip(*rest)) if len(set(cs)) > 1), min(map(len, rest)))]
    return head, tail[::-1]


def _namings(clusters: list[list[str]]) -> list[Naming | None]:
    """A naming for each level, from the columns, one of each level, that have most in common."""
    if len(clusters) < 2:
        return [None] * len(clusters)
    alike = lambda a, b: sum(map(len, _shared([a, b])))
    tries = [[max(cluster, key=lambda c: alike(first, c)) for cluster in clusters] for first in min(clusters, key=len)]
    tries = [[first if first in cluster else pick for cluster, pick in zip(clusters, t)] for first, t in zip(min(clusters, key=len), tries)]
    best = max([[c[0] for c in clusters], *tries], key=lambda t: sum(map(len, _shared(t))))
    head, tail = _shared(best)
    middles = [c[len(head) : len(c) - len(tail)] for c in best]
    return [Naming(head, m, tail) if m else None for m in middles]


def _numbers(codes: list[str], namings: list[Naming | None]) -> list[int]:
    """The level numbers that the names show, if every level shows one and they ascend; else 1, 2, ..."""
    shown = [re.search(r"\d+", n.level if n else c) for c, n in zip(codes, namings)]
    digits = [int(m[0]) for m in shown if m]
    return digits if len(digits) == len(codes) and digits == sorted(set(digits)) else list(range(1, len(codes) + 1))


def dependent(df: DataFrame, key: str, columns: list[str]) -> set[str]:
    """The columns that have one value at most for each value of key; one aggregation."""
    if not columns:
        return set()
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    most = per.agg(*[F.max(c).alias(c) for c in columns]).first()
    return {c for c in columns if (most[c] or 0) <= 1}


def detect_levels(df: DataFrame) -> dict[int, LevelColumns]:
    """Levels by number: the chain that hierarchy.infer_levels finds, completed by columns of the same naming.

    A whole-table constant of that naming is a root above it; a finer column of
    it whose values are unique under the deepest level is a leaf without code.
    """
    chain = hierarchy.infer_levels(df)
    if not chain:
        raise ValueError("the values show no hierarchy")
    namings = _namings([lv.columns for lv in chain])
    codes = [(lv.codes or lv.columns)[0] for lv in chain]
    numbers, taken = _numbers(codes, namings), {c for lv in chain for c in lv.columns}
    out: dict[int, LevelColumns] = {}
    for n, lv, code, naming in zip(numbers, chain, codes, namings):
        more = sorted(dependent(df, code, [c for c in df.columns if naming and c not in taken and naming.fits(c)]), key=df.columns.index)
        taken.update(more)
        own = [c for c in lv.columns if not naming or naming.fits(c)] + more
        out[n] = LevelColumns(own, lv.columns + more, code, next(iter(lv.names), None), bool(lv.codes) or n == numbers[0], naming)
    first = next((n for n in namings if n), None)
    if first and all(namings):
        used = {n.level for n in namings}
        others = {c[len(first.head) : len(c) - len(first.tail)] for c in df.columns if c not in taken and c.startswith(first.head) and c.endswith(first.tail) and len(c) > len(first.head + first.tail)} - used
        below = str(max(numbers) + 1)
        above = sorted(others - {below})
        if len(above) == 1 and 0 not in out:
            naming = Naming(first.head, above[0], first.tail)
            own = [c for c in df.columns if c not in taken and naming.fits(c)]
            counts = df.agg(*[F.count_distinct(c).alias(c) for c in own]).first()
            constant = [c for c in own if counts[c] <= 1]
            if constant:
                out[min(numbers) - 1] = LevelColumns(constant, [], None, None, True, naming)
        leaf = Naming(first.head, below, first.tail)
        own, parent = [c for c in df.columns if c not in taken and leaf.fits(c)], codes[-1]
        unique = [F.struct(F.count(c).alias("n"), F.count_distinct(F.when(F.col(c).isNotNull(), F.struct(parent, c))).alias("pairs")).alias(c) for c in own]
        if own:
            seen = df.agg(*unique).first()
            good = sorted(c for c in own if seen[c].n and seen[c].n - seen[c].pairs <= (seen[c].n > hierarchy.TOLERANCE_GROUPS))
            if good:
                out[int(below)] = LevelColumns(good, good, None, good[0], False, leaf)
    for lv in out.values():
        if lv.naming:
            lv.kinds = {c: lv.naming.kind(c).strip("_") or ("code" if c == lv.code else "name") for c in lv.columns}
    return dict(sorted(out.items()))


def detect_or_single(df: DataFrame) -> dict[int, LevelColumns]:
    """detect_levels, or one level without columns where the values show none."""
    try:
        return detect_levels(df)
    except ValueError:
        return {0: LevelColumns([], [], None, None, True)}


def cluster_guard(df: DataFrame, canonical: str, members: list[str], parent: str | None = None) -> DataFrame:
    """(member, variants, units, member_values, problem) of columns said to name the same units as canonical.

    fragments: several values in one unit; coarser: under a parent it has so few
    values beside the units that it names a level above.
    """
    rows = []
    for m in members:
        variants = df.where(F.col(canonical).isNotNull()).groupBy(canonical).agg(F.count_distinct(m).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("variants"))
        pair = lambda c: F.count_distinct(F.struct(*([parent] if parent else []), c))
        counts = df.where(F.col(m).isNotNull()).agg(pair(canonical).alias("units"), pair(m).alias("member_values"))
        rows.append(variants.crossJoin(counts).select(F.lit(m).alias("member"), "variants", "units", "member_values"))  # a row each
    merged = F.lit(parent is not None) & (F.col("units") > 0) & (1 - F.col("member_values") / F.greatest("units", F.lit(1)) > MOST_MERGED)
    return reduce(DataFrame.union, rows).withColumn("problem", F.when(F.col("variants") > 1, "fragments").when(merged, "coarser"))


def verify_cluster(df: DataFrame, canonical: str, members: list[str], parent: str | None = None) -> None:
    """Raise ValueError if cluster_guard has a problem."""
    bad = cluster_guard(df, canonical, [m for m in members if m != canonical], parent).where("problem is not null").collect() if set(members) - {canonical} else []
    if bad:
        raise ValueError("; ".join(f"{r.member} against {canonical}: {r.problem}" for r in bad))


# The level table and its findings.

_FIELDS = "level int, column_name string, family string, raw_family string, anchored boolean, is_code boolean, problem string, reason string"


def _plain(text: str) -> str:
    return re.sub("[^0-9a-z]", "", text.lower())


def _without(column: str, start: str, end: str) -> str | None:
    """column less start, or less end; None if neither fits, or a number would be cut."""
    for fits, edge, rest in ((start and column.startswith(start), start[-1:] + column[len(start) : len(start) + 1], column[len(start) :]), (end and column.endswith(end), column[: len(column) - len(end)][-1:] + end[:1], column[: len(column) - len(end)])):
        if fits and not re.fullmatch(r"[0-9]{2}", edge):
            return rest
    return None


def _column_row(n: int, column: str, naming: Naming | None, is_code: bool) -> tuple:
    if naming is None:
        return n, column, None, None, None, is_code, None, None
    start, end = naming.head + naming.level, naming.level + naming.tail
    raw = _without(column, start, end)
    if raw is not None:
        return n, column, _plain(raw), raw, True, is_code, None, None
    loose = _without(_plain(column), _plain(start), _plain(end))
    return n, column, _plain(column) if loose is None else loose, None, False, is_code, None, None


def _problem(n: int | None, column: str | None, kind: str, reason: str) -> tuple:
    return n, column, None, None, None, False, kind, reason


def _skipped(found: list[int]) -> list[tuple]:
    return [_problem(n, None, "level-skipped", f"there are levels {min(found)} to {max(found)} but for {n}") for n in range(min(found), max(found)) if n not in found]


def template_rows(columns: list[str], code: str) -> list[tuple]:
    """Level rows of the columns that follow a template, loosely or strictly."""
    head, tail = code.split("{n}")
    codes: dict[int, str] = {}
    for c in columns:
        m = re.fullmatch(rf"{_plain(head)}(\d+){_plain(tail)}", _plain(c))
        if m and (int(m[1]) not in codes or c == at_level(code, int(m[1]))):
            codes[int(m[1])] = c
    if not codes:
        return [_problem(None, None, "levels-undetected", f"no column is named as {code}")]
    rows = _skipped(list(codes))
    for n in sorted(codes):
        naming = Naming(head, str(n), tail)
        held = [c for c in columns if _without(c, head + str(n), str(n) + tail) is not None or _without(_plain(c), _plain(head + str(n)), "") is not None]
        rows += [_column_row(n, c, naming, c == codes[n]) for c in held]
    return rows


def common_template(codes: dict[int, str]) -> str | None:
    """The template that the code columns of all levels share, by its commonest spelling."""
    found = []
    for n, c in codes.items():
        spots = [m for m in re.finditer(r"\d+", c) if int(m[0]) == n]
        if len(spots) != 1:
            return None
        found.append(c[: spots[0].start()] + "{n}" + c[spots[0].end() :])
    return Counter(found).most_common(1)[0][0] if len(set(map(_plain, found))) == 1 else None


def structure_rows(df: DataFrame) -> list[tuple]:
    """Level rows without a template: the levels that the values show."""
    try:
        detected = detect_levels(df)
    except ValueError as e:
        return [_problem(None, None, "levels-undetected", str(e))]
    coded = {n: lv for n, lv in detected.items() if lv.group_by}
    grouped = {c for lv in detected.values() for c in (*lv.columns, *lv.group_by)}
    aside = [_problem(None, c, "supplemental-column", "groups rows, but is no level; name the templates if it is one") for c in hierarchy.coarser_groupings(df, [lv.code for lv in coded.values() if lv.code], grouped)]
    shared = common_template({n: lv.code for n, lv in coded.items() if lv.code})
    if shared:
        return aside + template_rows(df.columns, shared)
    rows = _skipped(list(coded)) + aside
    for n, lv in detected.items():
        rows += [_column_row(n, c, lv.naming, c == lv.code) for c in dict.fromkeys(([lv.code] if lv.code else []) + lv.columns)]
    return rows


def level_rows(df: DataFrame, code: str | None = None) -> DataFrame:
    """One row for each column of a level, and for each problem in finding the levels."""
    rows = template_rows(df.columns, code) if code else structure_rows(df)
    return df.sparkSession.createDataFrame(rows, _FIELDS)


def _naming_findings(rows: DataFrame) -> DataFrame:
    """Columns named otherwise than their like at other levels; ties of spellings go to the commonest style of the table."""
    own = rows.where("problem is null and family is not null")
    style = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw_family", "[0-9]+", ""), "[a-z]+", "a"), "[A-Z]+", "A")
    strict = own.where("anchored").withColumn("style", style)
    usual = strict.groupBy("style").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("style", F.struct("n", "style")).alias("usual"))
    spelt = strict.crossJoin(usual).groupBy("family", "raw_family").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("style") == F.col("usual")).alias("fits"), F.min("column_name").alias("example"))  # one row
    best = spelt.groupBy("family").agg(F.max(F.struct("n", "fits", "raw_family", "example")).alias("b")).select("family", "b.raw_family", "b.example").withColumnRenamed("raw_family", "right")
    odd = own.join(best, "family", "left").where(~F.col("anchored") | ~F.col("raw_family").eqNullSafe(F.col("right")))
    reason = F.when(F.col("example").isNull(), F.concat(F.lit("unlike the other columns of level "), F.col("level").cast("string"))).otherwise(F.concat(F.lit("its like at another level is "), "example"))
    return odd.select(F.lit("column-naming").alias("kind"), "level", "column_name", F.lit(None).cast("string").alias("code"), reason.alias("reason"))


def _missing_findings(rows: DataFrame) -> DataFrame:
    """Kinds of column that several levels have, and one lacks."""
    own = rows.where("problem is null and family is not null")
    kinds = own.groupBy("family").agg(F.collect_set("level").alias("levels"), F.min("column_name").alias("example")).where(F.size("levels") > 1)
    every = own.agg(F.collect_set("level").alias("every"))
    lacking = kinds.crossJoin(every).select("example", F.explode(F.array_except("every", "levels")).alias("level"))  # one row
    return lacking.select(F.lit("column-set-mismatch").alias("kind"), "level", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("code"), F.concat(F.lit("lacks the like of "), "example").alias("reason"))


def _link_findings(df: DataFrame, n: int, child: str, parent: str) -> DataFrame:
    """Codes of one level with several parents, or rows without one; one aggregation."""
    per = df.where(F.col(child).isNotNull()).groupBy(F.col(child).cast("string").alias("code")).agg(F.array_sort(F.collect_set(F.col(parent).cast("string"))).alias("parents"), F.max(F.col(parent).isNull()).alias("orphan"))
    many = F.when(F.size("parents") > 1, F.struct(F.lit("multiple-parents").alias("kind"), F.concat(F.lit("lies under "), F.array_join("parents", ", ")).alias("reason")))
    none = F.when(F.col("orphan"), F.struct(F.lit("orphan-child").alias("kind"), F.lit(f"has rows without {parent}").alias("reason")))
    return per.select("code", F.explode(F.array_compact(F.array(many, none))).alias("f")).select("f.kind", F.lit(n).alias("level"), F.lit(child).alias("column_name"), "code", "f.reason")


def schema_checks(df: DataFrame, code: str | None = None) -> DataFrame:
    """(kind, level, column_name, code, reason, severity): problems of the levels, their column names, and their links."""
    rows = level_rows(df, code)
    codes = {r.level: r.column_name for r in rows.where("is_code and problem is null").collect()}
    parts = [rows.where("problem is not null").select(F.col("problem").alias("kind"), "level", "column_name", F.lit(None).cast("string").alias("code"), "reason"), _naming_findings(rows), _missing_findings(rows)]
    ordered = sorted(codes)
    parts += [_link_findings(df, n, codes[n], codes[up]) for up, n in zip(ordered, ordered[1:])]
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("severity", F.when(F.col("kind").isin(SCHEMA_ERRORS), "error").otherwise("warn"))
