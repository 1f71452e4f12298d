"""Dissolves: grouping with a column policy that follows from the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "first": F.min}


def distinct_counts(df: DataFrame, group_by: list[str], columns: list[str]) -> DataFrame:
    """One row: for each column the most distinct non-null values that any group has."""
    per = df.groupBy(*group_by).agg(*[F.countDistinct(c).alias(c) for c in columns])
    return per.agg(*[F.max(c).alias(c) for c in columns])


def dissolve(df: DataFrame, group_by: list[str], *, exclude: list[str] = (), overrides: dict[str, str] | None = None, box: bool = False) -> DataFrame:
    """One row a group (a null key is a group of its own).

    Columns constant within every group are kept, other numeric ones summed, the
    rest dropped; overrides name sum, min, max, avg or first for a column. With
    box, the group's extent is added. Pass one counts, pass two aggregates: both
    reduce on the map side.
    """
    overrides = overrides or {}
    boxes = ["xmin", "ymin", "xmax", "ymax"] if box else []
    columns = [c for c in df.columns if c not in {*group_by, *exclude, *boxes}]
    counts = distinct_counts(df, group_by, columns).first() if columns else {}
    kept: list[Column] = []
    for c in columns:
        if c in overrides:
            kept.append(AGGREGATES[overrides[c]](c).alias(c))
        elif (counts[c] or 0) <= 1:
            kept.append(F.min(c).alias(c))
        elif isinstance(df.schema[c].dataType, NumericType):
            kept.append(F.sum(c).alias(c))
    kept += [f(c).alias(c) for c, f in zip(boxes, (F.min, F.min, F.max, F.max))]
    if not kept:
        return df.select(*group_by).distinct()
    return df.groupBy(*group_by).agg(*kept)


def boundary_level(pairs: DataFrame, levels: list[int], code: str = "adm{n}_code") -> DataFrame:
    """level of the boundary between two units: the first level at which their ancestor codes differ; null if none does."""
    tests = [F.when(~F.col(f"a_{code.format(n=n)}").eqNullSafe(F.col(f"b_{code.format(n=n)}")), F.lit(n)) for n in sorted(levels)]
    return pairs.withColumn("level", F.coalesce(*tests))


def fill_levels(df: DataFrame, levels: list[int], *, templates: tuple[str, ...] = ("adm{n}_code", "adm{n}_name"), depth: str = "adm_lvl") -> DataFrame:
    """Stamp the deepest level with a code, and cascade its columns to the levels below it.

    Columns of reached levels stay as they are, nulls included.
    """
    levels = sorted(levels)
    deepest = F.coalesce(*[F.when(F.col(templates[0].format(n=n)).isNotNull(), F.lit(n)) for n in reversed(levels)])
    df = df.withColumn(depth, deepest)
    new = {}
    for t in templates:
        present = [n for n in levels if t.format(n=n) in df.columns]
        for n in present:
            value = F.when(F.col(depth).isNull() | (F.col(depth) >= n), F.col(t.format(n=n)))
            for m in reversed([m for m in present if m < n]):
                value = value.when(F.col(depth) == m, F.col(t.format(n=m)))
            lower = [m for m in present if m < n]
            new[t.format(n=n)] = value if lower else F.col(t.format(n=n))
    return df.withColumns(new)


def rename_columns(df: DataFrame, crosswalk: list[tuple[str, str]], order_by: str | None = None) -> DataFrame:
    """Rename, drop and reorder by (source, target) rows; an empty target drops the column."""
    validate_crosswalk(df.columns, crosswalk)
    out = df.select(*[F.col(s).alias(t) for s, t in crosswalk if t])
    return out.orderBy(F.col(order_by).asc_nulls_last()) if order_by else out


def validate_crosswalk(columns: list[str], crosswalk: list[tuple[str, str]]) -> None:
    """Raise ValueError unless sources are exactly the columns, and targets unique and not reserved."""
    sources, targets = [s for s, _ in crosswalk], [t for _, t in crosswalk if t]
    for what, values in (("source", sources), ("target", targets)):
        twice = sorted({v for v in values if values.count(v) > 1})
        if twice:
            raise ValueError(f"{what} columns named twice: {', '.join(twice)}")
    if set(sources) != set(columns):
        raise ValueError(f"sources and columns differ: {', '.join(sorted(set(sources) ^ set(columns)))}")
    reserved = [t for t in targets if t.lower() in ("fid", "geom", "geometry")]
    if reserved:
        raise ValueError(f"reserved target names: {', '.join(reserved)}")


def level_units(df: DataFrame, levels: list[int], *, code: str = "adm{n}_code", name: str = "adm{n}_name") -> DataFrame:
    """The long table of code and name pairs of each level, with their parent and row count."""
    parts = []
    for k, n in enumerate(sorted(levels)):
        parent = F.col(code.format(n=sorted(levels)[k - 1])) if k else F.lit(None).cast("string")
        base = df.select(F.lit(n).alias("level"), F.lit(name.format(n=n)).alias("name_column"), F.lit(0).alias("name_index"), F.lit(code.format(n=n)).alias("code_column"), F.col(code.format(n=n)).alias("code"), parent.alias("parent_code"), F.col(name.format(n=n)).alias("name"))
        parts.append(base.groupBy(*base.columns).agg(F.count(F.lit(1)).alias("row_count")))
    return reduce(DataFrame.unionByName, parts)
