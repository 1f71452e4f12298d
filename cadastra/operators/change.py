"""Change between two versions of a layer: matching, clusters, classes, changelog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.boxes import overlap_pairs
from cadastra.operators.graph import components, one_to_one
from cadastra.storage import stored


@dataclass(frozen=True)
class ChangeOptions:
    """Thresholds and identity linking; link_mode counts only if both kinds of link are on."""

    tau_match: float = 0.8
    tau_same: float = 0.98
    link_by_code: bool = False
    link_by_name: bool = False
    link_mode: str = "either"


def unique_values(layer: DataFrame, column: str) -> DataFrame:
    """Values that one unit alone has: only these can anchor an identity."""
    return layer.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(column)


def with_keys(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(F.col("fid").alias("a_fid"), F.col("code").alias("code_a"), F.col("name").alias("name_a"))
    right = b.select(F.col("fid").alias("b_fid"), F.col("code").alias("code_b"), F.col("name").alias("name_b"))
    return pairs.join(left.hint("merge"), "a_fid", "left").join(right.hint("merge"), "b_fid", "left")


def identity_pairs(keyed: DataFrame, a: DataFrame, b: DataFrame, options: ChangeOptions) -> DataFrame:
    """Overlapping pairs that agree on anchored codes or names."""
    rules = []
    for on, column in ((options.link_by_code, "code"), (options.link_by_name, "name")):
        if on:
            anchors = unique_values(a, column).join(unique_values(b, column), column).select(F.col(column).alias(f"anchor_{column}"))
            keyed = keyed.join(anchors, (F.col(f"{column}_a") == F.col(f"{column}_b")) & (F.col(f"{column}_a") == F.col(f"anchor_{column}")), "left")
            rules.append(F.col(f"anchor_{column}").isNotNull())
    if not rules:
        return keyed.limit(0).select("a_fid", "b_fid")
    test = rules[0] if len(rules) == 1 else rules[0] & rules[1] if options.link_mode == "both" else rules[0] | rules[1]
    return keyed.where(test).select("a_fid", "b_fid")


def identity_claims(pairs: DataFrame, identity: DataFrame, options: ChangeOptions) -> DataFrame:
    """Identity pairs all of whose other spatial neighbours have an identity partner too, claimed in (a, b) order."""
    spatial = pairs.where(F.greatest("coverage_a", "coverage_b") >= options.tau_match).select("a_fid", "b_fid")
    open_b = spatial.join(identity.select("b_fid").distinct(), "b_fid", "left_anti").select("a_fid", F.col("b_fid").alias("other"))
    open_a = spatial.join(identity.select("a_fid").distinct(), "a_fid", "left_anti").select("b_fid", F.col("a_fid").alias("other"))
    ok = identity.join(open_b, "a_fid", "left_anti").join(open_a, "b_fid", "left_anti")
    return one_to_one(ok.select(F.col("a_fid").alias("a"), F.col("b_fid").alias("b"))).select(F.col("a").alias("a_fid"), F.col("b").alias("b_fid"))


def matched_pairs(pairs: DataFrame, claims: DataFrame, options: ChangeOptions) -> DataFrame:
    """Claims, then spatial pairs whose units are both unclaimed; rescued: a claim that space alone does not make."""
    passes = F.greatest("coverage_a", "coverage_b") >= options.tau_match
    claimed = pairs.join(claims, ["a_fid", "b_fid"]).select(pairs["*"], F.lit("identity").alias("match_method"), (~passes).alias("rescued"))
    free = pairs.where(passes).join(claims.select("a_fid"), "a_fid", "left_anti").join(claims.select("b_fid"), "b_fid", "left_anti")
    return claimed.unionByName(free.withColumns({"match_method": F.lit("spatial"), "rescued": F.lit(False)}))


def clusters(a: DataFrame, b: DataFrame, matched: DataFrame) -> DataFrame:
    """(side, fid, cluster): each unit once; a cluster is named by its least A node, else its least B node."""
    node_a, node_b = F.col("fid") * 2, F.col("fid") * 2 + 1
    nodes = a.select(node_a.alias("node")).union(b.select(node_b.alias("node")))
    edges = matched.select((F.col("a_fid") * 2).alias("a"), (F.col("b_fid") * 2 + 1).alias("b"))
    of = components(nodes, edges)
    of = of.select(F.when(F.col("node") % 2 == 0, "a").otherwise("b").alias("side"), F.floor(F.col("node") / 2).cast("long").alias("fid"), "component")
    first = of.groupBy("component").agg(F.min(F.when(F.col("side") == "a", F.col("fid"))).alias("first_a"), F.min(F.when(F.col("side") == "b", F.col("fid"))).alias("first_b"))
    name = F.when(F.col("first_a").isNotNull(), F.concat(F.lit("a"), "first_a")).otherwise(F.concat(F.lit("b"), "first_b"))
    return of.join(first, "component").select("side", "fid", name.alias("cluster"))


def _changed(column: str) -> Column:
    return F.coalesce(F.col(f"{column}_a") != F.col(f"{column}_b"), F.lit(False))


def cluster_classes(members: DataFrame, matched: DataFrame, options: ChangeOptions) -> DataFrame:
    """(cluster, n_a, n_b, relationship_class)."""
    counts = members.groupBy("cluster").agg(F.sum((F.col("side") == "a").cast("long")).alias("n_a"), F.sum((F.col("side") == "b").cast("long")).alias("n_b"))
    edge = matched.join(members.where("side = 'a'").select(F.col("fid").alias("a_fid"), "cluster"), "a_fid")
    facts = edge.groupBy("cluster").agg(F.max("iou").alias("best"), F.min(F.col("rescued").cast("int")).alias("rescued"), F.max((_changed("code") | _changed("name")).cast("int")).alias("renamed"))
    linked = options.link_by_code or options.link_by_name
    single = (
        F.when(F.col("rescued") == 1, "relocated")
        .when((F.col("best") >= options.tau_same) & (F.col("renamed") == 1) & F.lit(linked), "renamed")
        .when(F.col("best") >= options.tau_same, "unchanged")
        .otherwise("modified")
    )
    n, m = F.col("n_a"), F.col("n_b")
    kind = F.when(m == 0, "removed").when(n == 0, "created").when((n == 1) & (m == 1), single).when(n == 1, "split").when(m == 1, "merge").otherwise("complex")
    return counts.join(facts, "cluster", "left").select("cluster", "n_a", "n_b", kind.alias("relationship_class"))


@dataclass
class Change:
    """Tables of one comparison. Pairs are stored, so other thresholds start from them."""

    a: DataFrame
    b: DataFrame
    pairs: DataFrame
    matched: DataFrame
    members: DataFrame
    classes: DataFrame
    options: ChangeOptions

    def changelog(self) -> DataFrame:
        """One row for each matched pair and each unit without a match."""
        of = self.members.join(self.classes, "cluster")
        o = self.options
        echo = {"threshold_match": F.lit(o.tau_match), "threshold_same": F.lit(o.tau_same), "link_by_code": F.lit(o.link_by_code), "link_by_name": F.lit(o.link_by_name), "link_mode": F.lit(o.link_mode)}
        rows = self.matched.join(of.where("side = 'a'").select(F.col("fid").alias("a_fid"), "relationship_class"), "a_fid")
        keys = ["code_a", "name_a", "code_b", "name_b", "relationship_class", "match_method"]
        rows = rows.select(*keys, F.round("coverage_a", 3).alias("a_in_b"), F.round("coverage_b", 3).alias("b_in_a"), F.round("iou", 3).alias("similarity"))
        out = rows
        for side, kind, layer in (("a", "removed", self.a), ("b", "created", self.b)):
            alone = layer.hint("merge").join(of.where((F.col("side") == side) & (F.col("relationship_class") == kind)).select("fid", "relationship_class"), "fid")
            alone = alone.select(F.col("code").alias(f"code_{side}"), F.col("name").alias(f"name_{side}"), "relationship_class")
            out = out.unionByName(alone, allowMissingColumns=True)
        return out.withColumns(echo)


def compare(a: DataFrame, b: DataFrame, options: ChangeOptions = ChangeOptions(), pairs: DataFrame | None = None) -> Change:
    """Match and classify layers (fid, code, name, box); pairs of an earlier run are taken over."""
    pairs = stored(with_keys(overlap_pairs(a, b), a, b)) if pairs is None else pairs
    claims = stored(identity_claims(pairs, stored(identity_pairs(pairs, a, b, options)), options))
    matched = stored(matched_pairs(pairs, claims, options))
    members = stored(clusters(a, b, matched))
    return Change(a, b, pairs, matched, members, cluster_classes(members, matched, options), options)
