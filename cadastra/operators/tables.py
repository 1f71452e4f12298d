"""Small relational operators of the tools: keyed layers, sheets, HTML tables, encoded rows, write-backs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ["xmin", "ymin", "xmax", "ymax"]
#: Named entities that cells hold.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def keyed(layer: DataFrame, attributes: DataFrame, code_columns: list[str], name_column: str | None, *, key: str = "fid", shape: str = "xmin") -> DataFrame:
    """(fid, code, name, box) of units with a shape: the code columns joined, nulls skipped; null if all are."""
    parts = [F.col(c).cast("string") for c in code_columns]
    code = F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("", *parts)) if parts else F.lit(None).cast("string")
    own = attributes.select(key, code.alias("code"), (F.col(name_column).cast("string") if name_column else F.lit(None).cast("string")).alias("name"))
    return layer.where(F.col(shape).isNotNull()).select(key, *BOX).join(own, key, "left").select(key, "code", "name", *BOX)


def country_units(layer: DataFrame, iso3: str, code: str, name: str | None = None, left_out: list[str] = ()) -> DataFrame:
    """Units whose code starts with a country's three letters, without filler names and named waters."""
    own = layer.where(F.substring(code, 1, 3) == iso3)
    return own.where(F.coalesce(~F.col(name).isin(list(left_out)), F.lit(True))) if name and left_out else own


def suppress(findings: DataFrame, by: DataFrame, key: list[str]) -> DataFrame:
    """Findings without those that by explains (null-safe on key)."""
    explained = by.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return findings.join(explained, same, "left_anti")


def write_back(base: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """base with columns taken from the row of updates with the same key, where there is one (a null is written too)."""
    new = updates.select(*[F.col(c).alias(f"_k_{c}") for c in key], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    df = base.join(new, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key], "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return df.select(*[value(c) for c in base.columns])


def stored_matches(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stored match rows that were made against the source that a country has picked now."""
    live = decisions.select("iso", F.col("selected_source").alias("preferred"))
    return matches.join(live, (matches["iso"] == live["iso"]) & (matches["preferred_source"] == live["preferred"]), "left_semi")


def flagged_units(flags: DataFrame, units: DataFrame) -> DataFrame:
    """One row for each flag (key, fid) with the unit's box."""
    return flags.join(units.select("fid", *BOX), "fid").where("xmin is not null").select("key", "fid", *BOX)


def flagged_bounds(flagged: DataFrame) -> DataFrame:
    """The extent of each key."""
    return flagged.groupBy("key").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def decisions(sheet: DataFrame) -> DataFrame:
    """Typed rows of a decisions sheet (text columns, names in any case); the last row of a country counts.

    The sheet has a column _row with its order. The word null as source means
    that none is suitable.
    """
    named = {c.strip().lower(): c for c in sheet.columns}
    text = lambda c: F.trim(F.coalesce(F.col(f"`{named[c]}`"), F.lit(""))) if c in named else F.lit("")
    if "iso3" not in named:
        raise ValueError("the sheet has no column iso3")
    source = text("selected_source")
    none = F.lower(source) == "null"
    df = sheet.select(
        "_row", F.upper(text("iso3")).alias("iso3"), text("country_name").alias("country_name"), F.when(~none & (source != ""), source).alias("selected_source"), none.alias("no_source_suitable"),
        (F.lower(text("accepted")) == "true").alias("accepted"), text("rationale").alias("rationale"), F.nullif(text("last_updated"), F.lit("")).alias("last_updated"))
    last = df.where("iso3 <> ''").withColumn("_r", F.row_number().over(Window.partitionBy("iso3").orderBy(F.desc("_row")))).where("_r = 1")
    return last.drop("_r", "_row")


def cell_text(raw: Column) -> Column:
    """The text of a cell: no tags, entities decoded, trimmed."""
    out = F.regexp_replace(raw, "<[^>]+>", "")
    for entity, plain in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(plain))
    runs = F.split(out, "&#[0-9]+;", -1)
    codes = F.transform(F.regexp_extract_all(out, F.lit("&#([0-9]+);"), F.lit(1)), lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"))
    return F.trim(F.array_join(F.flatten(F.zip_with(runs, codes, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))


def html_rows(pages: DataFrame, key: str, html: str, tag: str = "tr", cells: str = "t[dh]") -> DataFrame:
    """(key, row, cells): the rows of the tables in a page; with tag ul and cells li, its lists."""
    body = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    cell = rf"(?is)<{cells}(?:\s[^>]*)?>(.*?)</{cells}>"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(body), F.lit(1))).alias("row", "inner"))
    own = F.transform(F.regexp_extract_all("inner", F.lit(cell), F.lit(1)), cell_text)
    return rows.select(key, F.col("row").cast("long").alias("row"), own.alias("cells")).where(F.size("cells") > 0)


def header_name(text: Column) -> Column:
    """A header cell as a column name: lower case, one underscore for what is no letter or digit."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def decode_rows(rows: DataFrame, group: str, order: str, columns: int, names: DataFrame | None = None) -> DataFrame:
    """(group, order, position, value) of rows that hold only what changed.

    Each row has repeat and empty (bit i: column i is as in the row before, or
    null) and values, the rest in order. A column's value is carried from the
    last row of the group that gives it, which is a running last value: the
    group's rows need no imperative pass. names (position, code, name) resolves
    codes; a code without a name is null.
    """
    bit = lambda mask, i: F.expr(f"(shiftright({mask}, {i}) & 1) = 1")
    given = [~bit("repeat", i) & ~bit("empty", i) for i in range(columns)]
    place = [sum((g.cast("int") for g in given[:i]), F.lit(0)) for i in range(columns)]
    fields = [F.struct(F.lit(i).alias("position"), bit("repeat", i).alias("again"), F.when(given[i], F.get(F.col("values"), place[i])).alias("value")) for i in range(columns)]
    each = rows.select(group, order, F.explode(F.array(*fields)).alias("f")).select(group, order, "f.*")
    # Null values count as given: they are wrapped before the last one is taken.
    held = F.last(F.when(~F.col("again"), F.struct(F.col("value").alias("v"))), ignorenulls=True).over(Window.partitionBy(group, "position").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = each.select(group, order, "position", held["v"].alias("value"))
    if names is None:
        return out
    known = names.select("position").distinct().withColumn("coded", F.lit(True))
    out = out.join(known, "position", "left").join(names.withColumnRenamed("code", "value"), ["position", "value"], "left")
    return out.select(group, order, "position", F.when(F.col("coded"), F.col("name")).otherwise(F.col("value").cast("string")).alias("value"))


def population_metrics(counts: DataFrame, areas: DataFrame, *, under: list[str]) -> DataFrame:
    """(unit, year, density, under5, over60, sex_ratio) from long rows (unit, year, grp, people) of each unit's latest year with a total.

    The share of the old needs every group of under.
    """
    last = counts.where("grp = 'T_TL'").groupBy("unit").agg(F.max("year").alias("year"))
    own = counts.join(last, ["unit", "year"])
    of = lambda g: F.sum(F.when(F.col("grp") == g, F.col("people")))
    young = F.col("grp").isin(under)
    per = own.groupBy("unit", "year").agg(of("T_TL").alias("t"), of("M_TL").alias("m"), of("F_TL").alias("f"), of("T_00_04").alias("t5"), F.when(F.sum(young.cast("int")) == len(under), F.sum(F.when(young, F.col("people")))).alias("u60"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    df = per.join(areas, "unit", "left")
    return df.select("unit", "year", ratio(F.col("t"), F.col("area")).alias("density"), ratio(100 * F.col("t5"), F.col("t")).alias("under5"), ratio(100 * (F.col("t") - F.col("u60")), F.col("t")).alias("over60"), ratio(100 * F.col("m"), F.col("f")).alias("sex_ratio"))


def metric_classes(df: DataFrame, metric: str, breaks: list[float]) -> DataFrame:
    """(class, label, n): units in each class of a metric; class -1 for none."""
    k = F.when(F.col(metric).isNull(), -1).otherwise(sum(((F.col(metric) >= b).cast("int") for b in breaks), F.lit(0)))
    labels = ["no data", f"under {breaks[0]:,}", *(f"{a:,} to {b:,}" for a, b in zip(breaks, breaks[1:])), f"{breaks[-1]:,} and over"]
    return df.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.array(*[F.lit(x) for x in labels])[F.col("class") + 1])


def long_table(change) -> DataFrame:
    """Rows of a comparison for a table: matched pairs, and units of clusters without the other side."""
    of = change.members.join(change.classes, "cluster")
    side = lambda s, layer: layer.select(F.col("fid").alias(f"{s}_fid"), F.col("code").alias(f"{s}_code"), F.col("name").alias(f"{s}_name"))
    pairs = change.matched.select("a_fid", "b_fid", "coverage_a", "coverage_b", "iou").join(of.where("side = 'a'").select(F.col("fid").alias("a_fid"), "cluster", "relationship_class"), "a_fid")
    rows = pairs.join(side("a", change.a), "a_fid", "left").join(side("b", change.b), "b_fid", "left")
    for s, other, layer in (("a", "n_b", change.a), ("b", "n_a", change.b)):
        alone = of.where((F.col("side") == s) & (F.col(other) == 0)).select(F.col("fid").alias(f"{s}_fid"), "cluster", "relationship_class").join(side(s, layer), f"{s}_fid", "left")
        rows = rows.unionByName(alone, allowMissingColumns=True)
    return rows.select("cluster", "relationship_class", "a_fid", "a_code", "a_name", "b_fid", "b_code", "b_name", "coverage_a", "coverage_b", "iou")


def seeded_codes(df: DataFrame, code: str, name: str, parent: str | None = None, *, examples: int = 5) -> DataFrame:
    """df with the code column taken from the names; raises ValueError if a name repeats under a parent.

    df has one row for each unit.
    """
    keys = ([parent] if parent else []) + [name]
    twice = df.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    shown = twice.select(F.concat_ws(" > ", *[F.col(k).cast("string") for k in keys]).alias("k")).orderBy("k").limit(examples).collect()
    if shown:
        raise ValueError(f"names that repeat under one parent, so codes can't follow them: {', '.join(r.k for r in shown)}")
    return df.withColumn(code, F.col(name).cast("string"))


def first_samples(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column_name, samples): the first n distinct values of each column as text, in order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    each = df.select(pairs.alias("p")).select("p.*").where("v is not null").distinct()
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where(F.col("r") <= n)
    return ranked.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]), "|").alias("samples"))
