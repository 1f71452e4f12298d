"""Status analytics: latest rows, ranks, dedup, coverage, conflicts, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(value: Column, order: list[str]) -> Column:
    """The place of a value in a list; values that are not in it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("long")


def plan_types(plans: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Distinct kinds of each key, sorted and joined."""
    return plans.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def enriched(orders: DataFrame, plans: DataFrame, key: str, year: str, kind: str) -> DataFrame:
    """orders with the kinds of plans of the same or a later year."""
    p = plans.groupBy(key, kind).agg(F.max(year).alias("_last"))
    hit = orders.join(p, key, "left")
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("_last") >= F.col(year), F.col(kind)))), ",")
    return hit.groupBy(*orders.columns).agg(names.alias("plan_types"))


def most_active(df: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The status of least rank for each key."""
    return df.groupBy(key).agg(F.min(F.struct(rank_of(F.col(status), order).alias("r"), F.col(status).alias("s"))).alias("m")).select(key, F.col("m.s").alias("status"))


def counts_in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, n, place): a row for each value of the list, 0 included."""
    spark = df.sparkSession
    base = spark.createDataFrame([(v, k + 1) for k, v in enumerate(order)], f"{column} string, place int")
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return base.join(n, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), F.col("place").cast("long").alias("place"))


def coverage(df: DataFrame, year: str, key: str, total: int) -> DataFrame:
    """(year, covered, share) of keys with a plan in each year."""
    return df.groupBy(year).agg(F.countDistinct(key).alias("covered")).withColumn("share", F.round(F.col("covered") / F.lit(total), 4))


def best_ever(df: DataFrame, key: str, kind: str, year: str, order: list[str]) -> DataFrame:
    """The best kind each key ever had, with its latest year."""
    m = F.min(F.struct(rank_of(F.col(kind), order).alias("r"), (-F.col(year)).alias("y"), F.col(kind).alias("k")))
    return df.groupBy(key).agg(m.alias("m")).select(key, F.col("m.k").alias("kind"), (-F.col("m.y")).alias("year"))


def next_review(df: DataFrame, key: str, date: str, years: int, today: str) -> DataFrame:
    """(key, last, due, overdue, months): review dates and the distance from today in months of 30.44 days."""
    due = F.add_months("last", 12 * years)
    out = df.groupBy(key).agg(F.max(date).alias("last")).withColumn("due", due)
    now = F.lit(today).cast("date")
    return out.select(key, "last", "due", (F.col("due") < now).alias("overdue"), F.round(F.datediff("due", now) / F.lit(30.44)).cast("long").alias("months"))


def hub_conflicts(votes: DataFrame, key: str, value: str, n: str, ratio: float = 2.0) -> DataFrame:
    """(key, value) of the value with the most votes, where it has ratio times those of the next."""
    w = Window.partitionBy(key).orderBy(F.desc(n), value)
    ranked = votes.withColumns({"r": F.row_number().over(w), "next": F.lead(n).over(w)})
    return ranked.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col(n) >= ratio * F.col("next")))).select(key, value)


def default_source(sources: DataFrame, key: str, source: str, order: list[int], picks: DataFrame | None = None) -> DataFrame:
    """The picked source where there is one with data, else the first of the order that has data."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(source))
    best = sources.where(rank > 0).groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(source).alias("s"))).alias("m")).select(key, F.col("m.s").alias("default_source"))
    if picks is None:
        return best
    good = picks.join(sources.select(key, F.col(source).alias("pick")), [key, "pick"], "left_semi")
    return best.join(good, key, "full").select(key, F.coalesce("pick", "default_source").alias("default_source"))


def level_pick(df: DataFrame, key: str, level: str, units: str) -> DataFrame:
    """(key, most_units, deepest): the level of most units (ties to the lower level), and the deepest with units."""
    m = F.max(F.struct(F.col(units), (-F.col(level)).alias("back")))
    return df.where(F.col(units) > 0).groupBy(key).agg((-m["back"]).alias("most_units"), F.max(level).alias("deepest"))


def class_breaks(df: DataFrame, value: str, breaks: list[float]) -> DataFrame:
    """Rows in each class: class k holds values of at least breaks[k - 1] and under breaks[k]."""
    k = sum(((F.col(value) >= b).cast("long") for b in breaks), F.lit(0).cast("long"))
    return df.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping or touching intervals of a key as one (running maximum, gaps and islands)."""
    w = Window.partitionBy(key).orderBy(start, end)
    ahead = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (ahead.isNull() | (F.col(start) > ahead)).cast("long")).withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def resolve_names(names: DataFrame, countries: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """(name, iso): by override, by equal name, else by the country name that holds all words of the name (least first)."""
    low = F.lower(F.trim("name"))
    fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]) if overrides else None
    c = countries.select(F.lower("country").alias("c"), "iso")
    exact = names.withColumn("c", low).join(c, "c", "left").drop("c")
    exact = exact.withColumn("iso", F.coalesce(fixed[low], "iso")) if fixed is not None else exact
    words = F.split(low, r"\W+")
    loose = exact.where("iso is null").drop("iso").join(F.broadcast(c), F.forall(words, lambda x: F.contains(F.col("c"), x)), "left").groupBy("name").agg(F.min("iso").alias("iso"))  # countries: a few hundred
    return exact.where("iso is not null").union(loose.select(*exact.columns))


def key_values(labels: DataFrame, column: str) -> DataFrame:
    """labels with key and value of "key: value" texts; those without a lower-case key or a value go."""
    good = labels.where(F.col(column).rlike("^[a-z][a-z_]*: *[^ ]"))
    return good.withColumns({"key": F.substring_index(column, ":", 1), "value": F.trim(F.split(column, ":")[1])})
