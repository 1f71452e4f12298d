"""Code update: carry the codes of an old version of a hierarchy over to a new one.

One level at a time: classified pairs decide whether a new unit keeps its old
number under its (new) parent, or gets the next free one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.boxes import BOX
from cadastra.operators.change import Change, ChangeOptions, compare
from cadastra.operators.codes import CodeFormat, last_component, padded
from cadastra.sources.layers import with_fid
from cadastra.storage import stored


def update_level(old: DataFrame, new: DataFrame, parents: DataFrame, form: CodeFormat, change: Change | None = None, options: ChangeOptions = ChangeOptions()) -> DataFrame:
    """(new_fid, old_code, new_code, relationship_class, outcome) of one level.

    old and new are layers (fid, code, name, box); parents gives (fid,
    parent_code) of each new unit. Unchanged and renamed units (and modified ones
    where codes have no delimiter) keep their own number under the new parent;
    where two land on one code, the least fid keeps it. Split units are new, with
    the old code as predecessor; merged and complex ones retire the old units.
    """
    change = change or compare(old, new, options)
    old, parents = old.hint("merge"), parents.hint("merge")
    of = change.members.join(change.classes, "cluster")
    b = of.where("side = 'b'").select(F.col("fid").alias("new_fid"), "cluster", "relationship_class")
    a = of.where("side = 'a'").join(old.select("fid", "code"), "fid").groupBy("cluster").agg(F.min("code").alias("old_code"), F.count(F.lit(1)).alias("olds"))
    rows = b.join(a, "cluster", "left").join(parents.select(F.col("fid").alias("new_fid"), "parent_code"), "new_fid")
    keeps = ["unchanged", "renamed"] + ([] if form.delimiter else ["modified"])
    kind = F.col("relationship_class")
    predecessor = F.when(kind.isin("created", "merge", "complex"), F.lit(None).cast("string")).otherwise(F.col("old_code"))
    tail = last_component(F.col("old_code"), form.delimiter) if form.delimiter else F.expr("substring(old_code, length(parent_code) + 1)")
    rows = rows.withColumn("kept_code", F.when(kind.isin(keeps), F.concat("parent_code", F.lit(form.delimiter), tail)))
    first = F.row_number().over(Window.partitionBy("kept_code").orderBy("new_fid"))
    rows = stored(rows.withColumn("kept_code", F.when(F.col("kept_code").isNotNull() & (first == 1), F.col("kept_code"))))
    retained = rows.where("kept_code is not null").select("new_fid", predecessor.alias("old_code"), F.col("kept_code").alias("new_code"), "relationship_class", F.lit("retained").alias("outcome"))
    # Numbers never come back: the start is above every old and kept number of the parent.
    codes = old.select("code").union(retained.select("new_code"))
    used = codes.select("code", F.substring_index("code", form.delimiter, -1).alias("tail"))
    number = F.col("tail").cast("long")
    prefix = F.expr(f"substring(code, 1, length(code) - length(tail) - {len(form.delimiter)})")
    top = used.where(F.col("tail").rlike(r"^\d{1,18}$")).groupBy(prefix.alias("parent_code")).agg(F.max(number).alias("top"))
    fresh = rows.where("kept_code is null").join(top, "parent_code", "left")
    place = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("parent_code").orderBy(F.col("new_fid").cast("string")))
    width = form.width_for(0) or 1
    fresh = fresh.select("new_fid", predecessor.alias("old_code"), F.concat("parent_code", F.lit(form.delimiter), padded(place, width)).alias("new_code"), "relationship_class", F.lit("new").alias("outcome"))
    gone = of.where("side = 'a'").where(F.col("relationship_class").isin("removed", "merge", "complex")).join(old.select("fid", "code"), "fid")
    gone = gone.select(F.lit(None).cast("long").alias("new_fid"), F.col("code").alias("old_code"), F.lit(None).cast("string").alias("new_code"), "relationship_class", F.lit("retired").alias("outcome"))
    return retained.unionByName(fresh).unionByName(gone)


def checked_side(df: DataFrame, levels: list[int], code: str, name: str, *, seed: bool = False) -> DataFrame:
    """df with a code for every row of every level; raises ValueError on blank codes, or a code with several names.

    With seed, a level without a code column takes its names, below the parent's
    code: "parent > name".
    """
    at = lambda template, n: template.format(n=n)
    for n in levels:
        if at(code, n) not in df.columns:
            if not seed or at(name, n) not in df.columns:
                raise ValueError(f"level {n} has no column {at(code, n)}")
            parts = [F.col(at(code, n - 1)).cast("string")] * (n - 1 in levels) + [F.col(at(name, n)).cast("string")]
            df = df.withColumn(at(code, n), F.when(F.col(at(name, n)).isNotNull(), F.concat_ws(" > ", *parts)))
    tests = [F.count_if(F.coalesce(F.trim(F.col(at(code, n)).cast("string")), F.lit("")) == "").alias(str(n)) for n in levels]
    blank = df.agg(*tests).first()
    several = {n: df.groupBy(at(code, n)).agg(F.count_distinct(at(name, n)).alias("k")).where("k > 1").count() for n in levels if at(name, n) in df.columns}
    problems = [f"level {n}: {blank[str(n)]} rows without a code" for n in levels if blank[str(n)]] + [f"level {n}: {k} codes with several names" for n, k in several.items() if k]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def level_layer(df: DataFrame, n: int, levels: list[int], code: str, name: str) -> DataFrame:
    """(fid, code, name, parent, box): the units of one level, numbered by code."""
    parent = F.min(code.format(n=n - 1)).cast("string") if n - 1 in levels else F.lit(None).cast("string")
    named = F.min(name.format(n=n)).cast("string") if name.format(n=n) in df.columns else F.lit(None).cast("string")
    units = df.groupBy(F.col(code.format(n=n)).cast("string").alias("code")).agg(named.alias("name"), parent.alias("parent"), *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))])
    return stored(with_fid(stored(units.repartitionByRange("code").sortWithinPartitions("code"))))


def update_hierarchy(old: DataFrame, new: DataFrame, levels: list[int], form: CodeFormat, *, options: ChangeOptions = ChangeOptions(), code: str = "adm{n}_code", name: str = "adm{n}_name") -> tuple[DataFrame, DataFrame]:
    """(new with its codes updated and a predecessor_code for each level, changelog) of two versions of a hierarchy with boxes.

    Levels go from the root down: each is dissolved on both sides, compared, and
    numbered under the codes that the level above has just been given.
    """
    levels = sorted(levels)
    old, new = checked_side(old, levels, code, name), checked_side(new, levels, code, name, seed=True)
    given, log, out = None, [], new
    for position, n in enumerate(levels):
        a, b = (level_layer(side, n, levels, code, name) for side in (old, new))
        if given is None:
            parents = b.select("fid", F.lit(form.root).alias("parent_code"))
        else:
            parents = b.join(given.select(F.col("raw").alias("parent"), F.col("new_code").alias("parent_code")), "parent").select("fid", "parent_code")
        own = CodeFormat(form.root, form.delimiter, form.width_for(position) or 1)
        change = compare(a.select("fid", "code", "name", *BOX), b.select("fid", "code", "name", *BOX), options)
        rows = stored(update_level(a.select("fid", "code", "name", *BOX), b, parents, own, change))
        given = stored(rows.where("new_fid is not null").join(b.select(F.col("fid").alias("new_fid"), F.col("code").alias("raw"), "name"), "new_fid").select("raw", "name", "new_code", "old_code"))
        log.append(rows.join(given.select("new_code", "name"), "new_code", "left").select(F.lit(n).alias("level"), "old_code", "new_code", "name", "relationship_class", "outcome"))
        column = code.format(n=n)
        pairs = given.select(F.col("raw").alias("_raw"), F.col("new_code").alias("_new"), F.col("old_code").alias(f"predecessor_{column}"))
        out = out.join(pairs, F.col(column).cast("string") == F.col("_raw"), "left").withColumn(column, F.col("_new")).drop("_raw", "_new")
    return out, reduce(DataFrame.unionByName, log)


def overflowing(log: DataFrame, form: CodeFormat, levels: list[int]) -> DataFrame:
    """(level, parent_code, children, width): parents whose children need more digits than the format has."""
    width = F.create_map(*[F.lit(x) for k, n in enumerate(sorted(levels)) for x in (n, form.width_for(k) or 18)])[F.col("level")]
    prefix = F.expr(f"substring(new_code, 1, length(new_code) - length(substring_index(new_code, '{form.delimiter}', -1)) - {len(form.delimiter)})")
    per = log.where("new_code is not null").groupBy("level", prefix.alias("parent_code")).agg(F.count(F.lit(1)).alias("children"), F.first(width).alias("width"))
    return per.where(F.col("children") > F.pow(F.lit(10), F.col("width")) - 1)
