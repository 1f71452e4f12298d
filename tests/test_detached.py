"""Pieces that a clip cuts off, each outcome of the rule once."""

import pytest
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, register_geometry
from cadastra.operators.detached import merge_detached


def layer(spark, shapes):
    register_geometry(spark)
    text = lambda boxes: "MULTIPOLYGON(" + ",".join(f"(({a} {b},{c} {b},{c} {d},{a} {d},{a} {b}))" for a, b, c, d in boxes) + ")" if isinstance(boxes, list) else boxes
    df = spark.createDataFrame([(k, text(v)) for k, v in shapes.items()], "fid long, t string")
    return df.select("fid", geo("from_text", "t").alias("geom"))


#: Unit 1 was one shape whose middle the clip took away: a large piece on the left, a small one at x 30 beside unit 2.
WHOLE = {1: [(0, 0, 31, 10)], 2: [(31, 0, 50, 10)]}
CUT = {1: [(0, 0, 20, 10), (30, 4, 31, 5)], 2: [(31, 0, 50, 10)]}
RIM = {0: "MULTIPOLYGON(((0 0,20 0,20 10,0 10,0 0)),((30 4,31 4,31 0,50 0,50 10,31 10,31 5,30 5,30 4)))"}


def run(spark, cut, before, rim, original=None):
    out, issues = merge_detached(layer(spark, cut), layer(spark, before), layer(spark, rim).select("geom"), None if original is None else layer(spark, original).select("geom"))
    areas = {r.fid: round(r.a, 6) for r in out.select("fid", geo("area", "geom").alias("a")).collect()}
    return areas, {(r.fid, r.to_fid, r.outcome) for r in issues.collect()}


def test_a_sliced_piece_goes_to_its_neighbour(spark):
    areas, issues = run(spark, CUT, WHOLE, RIM, WHOLE)
    assert issues == {(1, 2, "merged")} and areas == {1: 200.0, 2: 191.0}


def test_without_an_original_layer_nothing_moves(spark):
    areas, issues = run(spark, CUT, WHOLE, RIM)
    assert issues == {(1, 2, "no-original")} and areas == {1: 201.0, 2: 190.0}


def test_large_and_isolated_pieces_stay(spark):
    cut = {1: [(0, 0, 20, 10), (28, 0, 31, 5)], 2: [(31, 0, 50, 10)]}
    assert run(spark, cut, WHOLE, RIM, WHOLE) == ({1: 215.0, 2: 190.0}, {(1, 2, "too-large")})
    alone = {1: [(0, 0, 20, 10), (25, 4, 26, 5)], 2: [(31, 0, 50, 10)]}
    assert run(spark, alone, WHOLE, RIM, WHOLE) == ({1: 201.0, 2: 190.0}, set())


def test_a_drawn_lobe_stays(spark):
    """The neck between the pieces was never original land: the extension drew it, and the clip took it back."""
    original = {1: [(0, 0, 20, 10), (30, 4, 31, 5)], 2: [(31, 0, 50, 10)]}
    assert run(spark, CUT, WHOLE, RIM, original) == ({1: 201.0, 2: 190.0}, {(1, 2, "lobe")})


def test_a_layer_of_single_parts_is_left_alone(spark):
    assert run(spark, WHOLE, WHOLE, RIM, WHOLE) == ({1: 310.0, 2: 190.0}, set())
