"""Evidence for hierarchies among columns, and the chain of levels it supports.

Statistics of all pairs come from a few jobs over the data; the small matrices
are then weighed on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, NumericType, TimestampNTZType, TimestampType, DateType

# Fixed values of the inference.
TOLERANCE_GROUPS, STRICT_GROUPS, NEAR_UNIQUE, CODE_SHAPED, COLLAPSE = 2, 10, 0.9, 0.5, 0.3
# Columns that programs add by themselves, and how long a name can be in a DBF file.
NOISE = ["objectid", "globalid", "fid", "shape_leng", "shape_length", "shape__length", "shape_area", "shape__area", "ogc_fid", "ogc_fid_orig", "fid_orig"]
DBF_NAME = 10
GEOMETRY = ["geom", "geometry"]


def is_noise(column: str) -> bool:
    """A noise column, maybe numbered; a number at the end of a name cut to DBF_NAME characters may stand in a cut name."""
    low = column.lower()
    bare = re.sub(r"_\d+$", "", low)
    return low in NOISE or (bare != low and (bare in NOISE or (len(low) == DBF_NAME and any(x.startswith(bare) for x in NOISE))))


def candidate_columns(df: DataFrame) -> list[str]:
    """Columns that may take part: neither noise, geometry nor temporal."""
    return [f.name for f in df.schema if not is_noise(f.name) and f.name.lower() not in GEOMETRY and not isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]


def coarser_groupings(df: DataFrame, codes: list[str], taken: set[str]) -> list[str]:
    """Columns outside the levels that group the units of one: contained by it, with fewer values and more than one."""
    left = [c for c in candidate_columns(df) if c not in taken and not isinstance(df.schema[c].dataType, FractionalType)]
    if not left or not codes:
        return []
    counts = {r.column_name: r.distinct_values for r in populated(df, [*left, *codes]).collect()}
    out = set()
    for code in codes:
        for r in containment(df, code, left).collect():
            if holds(r.groups, r.violators) and 1 < counts[r.coarser] < counts[code]:
                out.add(r.coarser)
    return [c for c in left if c in out]


def populated(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, filled, distinct_values, code_share) in one scan."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggs += [F.count(c).alias(f"f_{c}"), F.countDistinct(c).alias(f"d_{c}")]
    one = df.agg(*aggs)
    rows = ", ".join(f"'{c}', f_{c}, d_{c}, n" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {rows}) AS (column_name, filled, distinct_values, n_rows)")


def containment(df: DataFrame, finer: str, coarser: list[str]) -> DataFrame:
    """(finer, coarser, groups, violators): values of finer that meet not just one coarser value, or a null one; one groupBy for all coarser columns."""
    aggs = []
    for c in coarser:
        aggs += [((F.countDistinct(c) != 1) | (F.count(c) != F.count(F.lit(1)))).cast("long").alias(f"v_{c}")]
    per = df.where(F.col(finer).isNotNull()).groupBy(finer).agg(*aggs)
    total = per.agg(F.count(F.lit(1)).alias("groups"), *[F.coalesce(F.sum(f"v_{c}"), F.lit(0)).alias(f"v_{c}") for c in coarser])
    rows = ", ".join(f"'{c}', groups, v_{c}" for c in coarser)
    return total.selectExpr(f"'{finer}' AS finer", f"stack({len(coarser)}, {rows}) AS (coarser, groups, violators)")


def holds(groups: int, violators: int) -> bool:
    """Containment holds; one violator is let pass among more than two groups."""
    return violators == 0 or (violators == 1 and groups > TOLERANCE_GROUPS)


def perfect(groups: int, violators: int) -> bool:
    return groups >= STRICT_GROUPS and violators == 0


def code_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, share) of non-null values that hold a digit."""
    one = df.agg(*[F.avg(F.col(c).cast("string").rlike("[0-9]").cast("int")).alias(c) for c in columns])
    return one.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (column_name, share)")


def embeds(df: DataFrame, child: str, parent: str, *, prefix: bool = False) -> DataFrame:
    """(rows_tested, failing, culprits): rows whose child text does not hold the parent's, and their distinct child values."""
    a, b = F.col(child).cast("string"), F.col(parent).cast("string")
    ok = F.coalesce(a.startswith(b) if prefix else F.contains(a, b), F.lit(False))
    rows = df.where(b.isNotNull() & (F.trim(b) != ""))
    return rows.agg(F.count(F.lit(1)).alias("rows_tested"), F.coalesce(F.sum((~ok).cast("long")), F.lit(0)).alias("failing"), F.countDistinct(F.when(~ok, a)).alias("culprits"))


def joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """(joint_values, violators, widest): one-to-one correspondence of a to b on the rows that have both."""
    per = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.countDistinct(b).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("joint_values"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("violators"), F.coalesce(F.max("n"), F.lit(0)).alias("widest"))


def near_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, ratio) of distinct values to rows."""
    return populated(df, columns).select("column_name", (F.col("distinct_values") / F.col("n_rows")).alias("ratio"))


def fractional(df: DataFrame) -> DataFrame:
    """(column_name, fractional) of floating columns: whether any value has a fraction; such columns are measurements."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, FractionalType)]
    one = df.agg(*[F.bool_or(F.col(c) != F.floor(c)).alias(c) for c in columns])
    return one.selectExpr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (column_name, fractional)")


def spatial_coherence(df: DataFrame, group: str) -> DataFrame:
    """(groups, n_rows, r2): the share of the variance of box centres that a grouping explains."""
    points = df.select(F.col(group).alias("g"), ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y")).where("g is not null")
    per = points.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.var_pop("x") + F.var_pop("y")).alias("v"))
    inside = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("v")).alias("within"))
    whole = points.agg((F.count(F.lit(1)) * (F.var_pop("x") + F.var_pop("y"))).alias("total"))
    return inside.crossJoin(whole).select("groups", "n_rows", F.round(1 - F.col("within") / F.nullif("total", F.lit(0.0)), 6).alias("r2"))  # one row each


@dataclass
class Level:
    """Columns that name one level: those that correspond one to one."""

    columns: list[str]
    count: int
    codes: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def infer_levels(df: DataFrame, columns: list[str] | None = None) -> list[Level]:
    """The longest chain of levels, coarsest first: equal counts and mutual containment make a level, containment orders levels."""
    columns = columns or candidate_columns(df)
    measured = {r.column_name for r in fractional(df).collect() if r.fractional} if any(isinstance(df.schema[c].dataType, FractionalType) for c in columns) else set()
    columns = [c for c in columns if c not in measured]
    if not columns:
        return []
    stats = {r.column_name: r for r in populated(df, columns).collect()}
    columns = [c for c in columns if stats[c].filled and stats[c].distinct_values > 1]
    inside = {}
    for finer in columns:
        others = [c for c in columns if c != finer]
        if others:
            inside.update({(r.coarser, finer): r for r in containment(df, finer, others).collect()})
    contains = {k for k, r in inside.items() if holds(r.groups, r.violators)}
    levels: list[Level] = []
    for c in sorted(columns, key=lambda c: (stats[c].distinct_values, c)):
        home = next((lv for lv in levels if lv.count == stats[c].distinct_values and all((c, o) in contains and (o, c) in contains for o in lv.columns)), None)
        if home:
            home.columns.append(c)
        else:
            levels.append(Level([c], stats[c].distinct_values))
    edge = lambda a, b: a.count < b.count and all((x, y) in contains for x in a.columns for y in b.columns)
    best: list[list[Level]] = []
    for k, lv in enumerate(levels):
        before = [best[j] for j in range(k) if edge(levels[j], lv)]
        best.append(max(before, key=len, default=[]) + [lv])
    chain = max(best, key=lambda c: (len(c), len(c[-1].columns), c[-1].count), default=[])
    if len(chain) == 1 and len(chain[0].columns) == 1:
        return []
    flat = [c for lv in chain for c in lv.columns]
    shares = {r.column_name: r.share or 0.0 for r in code_shares(df, flat).collect()} if flat else {}
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    for lv in chain:
        lv.codes = [c for c in lv.columns if shares[c] > CODE_SHAPED or c in numeric]
        lv.names = [c for c in lv.columns if c not in lv.codes]
    return chain


def crosswalk(df: DataFrame, *, code: str = "adm{n}_code", name: str = "adm{n}_name", first: int = 1) -> DataFrame:
    """(column_order, source_column, target_column, unique_count, note) for every column of df."""
    chain = infer_levels(df)
    target = {}
    for k, lv in enumerate(chain):
        for template, columns in ((code, lv.codes), (name, lv.names)):
            for i, c in enumerate(columns):
                target[c] = template.format(n=first + k) + (f"_{i}" if i else "")
    counts = {r.column_name: r.distinct_values for r in populated(df, df.columns).collect()}
    rows = [(i, c, target.get(c), counts[c], None if c in target else "supplemental") for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "column_order int, source_column string, target_column string, unique_count long, note string")


def schema_findings(df: DataFrame, levels: list[int], template: str = "adm{n}_code") -> DataFrame:
    """(kind, level, code, reason): codes with several parents, and codes whose parent is missing."""
    parts = []
    for up, n in zip(sorted(levels), sorted(levels)[1:]):
        child, parent = template.format(n=n), template.format(n=up)
        per = df.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("code")).agg(F.countDistinct(parent).alias("parents"), F.sum(F.col(parent).isNull().cast("long")).alias("orphans"))
        many = per.where("parents > 1").select(F.lit("multiple-parents").alias("kind"), F.lit(n).alias("level"), "code", F.concat(F.col("parents").cast("string"), F.lit(" parents")).alias("reason"))
        none = per.where("orphans > 0").select(F.lit("orphan-child"), F.lit(n), "code", F.lit("rows without a parent code"))
        parts += [many, none]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
