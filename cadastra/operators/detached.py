"""Pieces that a clip cuts off their unit: which of them go to the neighbour they touch.

Of the pieces that come from one part of a unit before the clip, the largest on
the unit's original land stays; each other one has an outcome: isolated (no
neighbour), too-large, unattached (a union would stay in two), no-original (no
layer to judge by), lobe (the unit was drawn that way) or merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, union_agg, with_bounds
from cadastra.operators.boxes import BOX, box_join
from cadastra.operators.polygons import SNAP
from cadastra.storage import stored

# A piece is small beside the one that stays; the share of original land; the neck that a clip sliced.
SMALL, ORIGINAL_SHARE, NECK = 0.01, 0.5, 0.1


def _pieces(layer: DataFrame) -> DataFrame:
    """(piece, fid, multi, geom, area, box): the parts of every unit, named by content."""
    parts = layer.select("fid", F.size(geo("parts", "geom")).alias("_n"), F.posexplode(geo("parts", "geom")).alias("_k", "geom"))
    return with_bounds(parts.select(F.xxhash64("fid", "_k").alias("piece"), "fid", (F.col("_n") > 1).alias("multi"), "geom", geo("area", "geom").alias("area")))


def _on(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs a (piece) and b (place) where the place covers the piece's interior point."""
    points = with_bounds(pieces.select("piece", "fid", geo("inside", "geom").alias("geom")))
    return box_join(points, places).where(geo("covers", "b_geom", "a_geom"))


def owned_land(original: DataFrame, before: DataFrame) -> DataFrame:
    """(piece, fid, geom, box): parts of the original layer, each with the unit before the clip that holds its feature's interior point."""
    features = with_bounds(original.select("geom")).withColumn("piece", F.xxhash64("geom")).withColumn("fid", F.lit(0).cast("long"))
    held = _on(features.select("piece", "fid", "geom"), before.select("fid", "geom", *BOX)).groupBy(F.col("a_piece").alias("piece")).agg(F.min("b_fid").alias("fid"))
    return _pieces(features.select("piece", "geom").join(held, "piece").select("fid", "geom")).select("piece", "fid", "geom", *BOX)


def outcomes(clipped: DataFrame, before: DataFrame, boundary: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """(piece, fid, to_fid, area, outcome, geom) of every piece that does not stay by itself.

    clipped and before are (fid, geom) after and before the clip, boundary (geom)
    is what was clipped to, original the layer as it was first drawn.
    """
    pieces = stored(_pieces(clipped))
    split = pieces.where("multi")
    source = stored(_pieces(before.join(split.select("fid").distinct(), "fid", "left_semi")))
    came = _on(split, source.select("piece", "fid", "geom", "area", *BOX)).where("a_fid = b_fid").groupBy(F.col("a_piece").alias("piece")).agg(F.max_by("b_piece", F.struct("b_area", "b_piece")).alias("part"))
    rows = split.join(came, "piece", "left").withColumn("part", F.coalesce("part", "piece"))
    land = None
    if original is None:
        rows = rows.withColumn("on_land", F.lit(True))
    else:
        land = stored(owned_land(original, with_bounds(before.select("fid", "geom"))))
        stands = _on(split, land).where("a_fid = b_fid").select(F.col("a_piece").alias("piece")).distinct().withColumn("stands", F.lit(True))
        shared = box_join(split.select("piece", "fid", "geom", *BOX), land).where("a_fid = b_fid").groupBy(F.col("a_piece").alias("piece")).agg(F.sum(F.coalesce(geo("area", geo("intersection", "a_geom", "b_geom")), F.lit(0.0))).alias("shared"))
        rows = rows.join(stands, "piece", "left").join(shared, "piece", "left").withColumn("on_land", F.coalesce(F.col("stands") | (F.col("shared") >= ORIGINAL_SHARE * F.col("area")), F.col("shared") >= ORIGINAL_SHARE * F.col("area"), F.lit(False)))
    own = Window.partitionBy("fid", "part")
    rows = rows.withColumn("kept", F.row_number().over(own.orderBy(F.desc("on_land"), F.desc("area"), "piece")) == 1)
    rows = rows.withColumn("kept_area", F.max(F.when(F.col("kept"), F.col("area"))).over(own))
    cut = stored(rows.where("not kept").select("piece", "fid", "geom", "area", (F.col("area") < SMALL * F.col("kept_area")).alias("small"), *BOX))

    others = pieces.join(cut.where("small").select("piece"), "piece", "left_anti")
    near = box_join(cut.select("piece", "fid", "geom", *BOX), others.select("piece", "fid", "geom", *BOX), pad=SNAP).where("a_fid <> b_fid")
    near = near.withColumn("contact", geo("contact", "b_geom", "a_geom", F.lit(SNAP))).where(F.col("contact") > 10 * SNAP)
    best = near.groupBy(F.col("a_piece").alias("piece")).agg(F.max_by(F.struct("b_fid", "b_geom"), F.struct("contact", -F.col("b_fid"))).alias("to"))
    out = cut.join(best, "piece", "left")
    whole = F.size(geo("parts", geo("union_all", F.array("geom", "to.b_geom")))) == 1
    first = F.when(F.col("to").isNull(), "isolated").when(~F.col("small"), "too-large").when(whole, "candidate").otherwise("unattached")
    out = stored(out.withColumn("outcome", first).select("piece", "fid", F.col("to.b_fid").alias("to_fid"), "area", "outcome", "geom", *BOX))
    if land is None:
        return out.withColumn("outcome", F.when(F.col("outcome") == "candidate", "no-original").otherwise(F.col("outcome"))).drop(*BOX)

    # A lobe is mostly original land and none of that was cut away beside it.
    tried = out.where("outcome = 'candidate'")
    beside = box_join(tried.select("piece", "fid", "geom", "area", *BOX), land, pad=SNAP).where("a_fid = b_fid").where(geo("intersects", "b_geom", geo("buffer", "a_geom", F.lit(SNAP))))
    held = union_agg(beside.select(F.col("a_piece").alias("piece"), F.col("b_geom").alias("geom")), ["piece"]).withColumnRenamed("geom", "land")
    rim = union_agg(boundary.select("geom"), []).withColumnRenamed("geom", "rim")  # one row
    rule = tried.join(held, "piece", "left").crossJoin(F.broadcast(rim))
    outside = F.filter(geo("parts", geo("difference", "land", "rim")), lambda g: geo("intersects", g, geo("buffer", "geom", F.lit(SNAP))))
    rule = rule.select("piece", "area", F.coalesce(geo("area", geo("intersection", "geom", "land")), F.lit(0.0)).alias("own"), F.explode_outer(outside).alias("g"))
    rule = rule.groupBy("piece").agg(F.first("area").alias("a"), F.first("own").alias("own"), F.coalesce(F.sum(geo("area", "g")), F.lit(0.0)).alias("neck"))
    merged = rule.select("piece", ((F.col("own") < ORIGINAL_SHARE * F.col("a")) | (F.col("neck") >= NECK * F.col("a"))).alias("merged"))
    final = F.when(F.col("outcome") != "candidate", F.col("outcome")).when(F.col("merged"), "merged").otherwise("lobe")
    return out.join(merged, "piece", "left").withColumn("outcome", final).drop("merged", *BOX)


def merge_detached(clipped: DataFrame, before: DataFrame, boundary: DataFrame, original: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(layer with merged pieces at their neighbours, issues (kind, fid, to_fid, outcome, area)): isolated pieces are no issue."""
    found = stored(outcomes(clipped, before, boundary, original))
    moved = found.where("outcome = 'merged'")
    touched = moved.select("fid").union(moved.select("to_fid")).distinct()
    again = _pieces(clipped.join(touched, "fid", "left_semi")).join(moved.select("piece"), "piece", "left_anti").select("fid", "geom")
    rebuilt = union_agg(again.union(moved.select(F.col("to_fid").alias("fid"), "geom")), ["fid"])
    layer = clipped.select("fid", "geom").join(touched, "fid", "left_anti").union(rebuilt)
    return layer, found.where("outcome <> 'isolated'").select(F.lit("detached-part").alias("kind"), "fid", "to_fid", "outcome", "area")
