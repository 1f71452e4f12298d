"""Joins, unions and ids where one box, group or file is far larger than the rest."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, register_geometry, union_agg
from cadastra.operators import boxes
from cadastra.sources.layers import with_fid

LAYER = "fid long, xmin double, ymin double, xmax double, ymax double"


def layer(spark, rng, n, sizes):
    rows = []
    for i in range(n):
        w, h = rng.choice(sizes) * rng.random(), rng.choice(sizes) * rng.random()
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        rows.append((i, x, y, x + w, y + h))
    return rows, spark.createDataFrame(rows, LAYER)


@pytest.mark.parametrize("pad", [0.0, 1.3])
def test_boxes_of_many_sizes(spark, pad):
    rng = random.Random(3)
    a, da = layer(spark, rng, 150, [0, 0.1, 3, 70])
    b, db = layer(spark, rng, 150, [0, 0.01, 1, 5, 100])
    want = {(p[0], q[0]) for p in a for q in b if p[1] - pad <= q[3] and p[3] + pad >= q[1] and p[2] - pad <= q[4] and p[4] + pad >= q[2]}
    for cell in (None, 0.37, 3.0):
        rows = [(r.a_fid, r.b_fid) for r in boxes.box_join(da, db, pad=pad, cell=cell).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_one_world_box_among_small_ones_makes_few_rows(spark):
    small = spark.range(20_000).select("id", (F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y")).selectExpr("id as fid", "x * 0.01 as xmin", "y * 0.01 as ymin", "x * 0.01 + 0.01 as xmax", "y * 0.01 + 0.01 as ymax")
    world = spark.createDataFrame([(0, -180.0, -90.0, 180.0, 90.0)], LAYER)
    least, classes = boxes.size_classes(small, world)
    assert boxes.box_join(small, world).count() == 20_000 and len(classes) <= 3 and 360 / least > 1000
    plan = boxes.box_join(world, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_union_of_a_large_group_takes_a_tree(spark):
    register_geometry(spark)
    text = F.format_string("POLYGON((%s 0,%s 0,%s 1,%s 1,%s 0))", "x", F.col("x") + 1, F.col("x") + 1, "x", "x")
    df = spark.range(3000).withColumn("x", F.col("id") % 700).select(F.when(F.col("id") % 10 > 0, "big").alias("k"), geo("from_text", text).alias("geom"))
    got = {r.k: r.a for r in union_agg(df, ["k"], fan=5).select("k", F.round(geo("area", "geom"), 6).alias("a")).collect()}
    assert got == {"big": 630.0, None: 70.0}
    assert round(union_agg(df, [], fan=7).select(geo("area", "geom").alias("a")).first().a, 6) == 700.0
    assert union_agg(df.limit(0), ["k"]).count() == 0


def test_ids_follow_the_files(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("fid")).repartition(6).write.parquet(f"{tmp_path}/t")
    rows = with_fid(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted(r.fid for r in rows) == list(range(1, 1001)) and sorted(r.v for r in rows) == list(range(1000)) and {r.fid_orig for r in rows} == {"x"}


def test_tables_of_small_files_are_not_broadcast(spark):
    """1.2 million boxes compress to a file below the broadcast limit and are far larger in memory."""
    from cadastra.operators.change import with_keys
    from cadastra.storage import stored

    rows = spark.range(100).selectExpr("id as fid", "'c' || id as code", "'n' || id as name", *[f"cast(id as double) as {c}" for c in boxes.BOX])
    for df in (stored(rows).where("fid > 3").join(stored(rows).select("fid"), "fid"), boxes.box_join(stored(rows), stored(rows)), boxes.box_join(rows, rows), with_keys(rows.selectExpr("fid as a_fid", "fid as b_fid"), rows, rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_kernel_sees_a_pair_once(spark):
    """As conditions of the join, areas were taken in every cell that two boxes share, and in both orders."""
    from cadastra.operators import polygons

    register_geometry(spark)
    rows = spark.range(100).selectExpr("id as fid", *[f"cast(id + {d} as double) as {c}" for c, d in zip(boxes.BOX, (0, 0, 2, 2))]).withColumn("geom", geo("box", *boxes.BOX))
    found = polygons.overlap_regions(rows).where(geo("area", "geom") > 0)
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert joins and not any("geo_" in line for line in joins) and found.count() == 99


def test_small_boxes_meet_each_other_in_their_own_cells_only(spark):
    small = spark.range(400).selectExpr("id as fid", "cast(id % 20 as double) as xmin", "cast(floor(id / 20) as double) as ymin", "id % 20 + 1.0D as xmax", "floor(id / 20) + 1.0D as ymax")
    world = spark.createDataFrame([(1000 + k, -1.0, -1.0, 21.0, 21.0) for k in range(2)], LAYER)
    both = small.union(world)
    pairs = boxes.box_join(both, both)
    assert pairs.where("a_fid < 1000 and b_fid >= 1000").count() == 800 == pairs.where("a_fid >= 1000 and b_fid < 1000").count()
    assert pairs.where("a_fid >= 1000 and b_fid >= 1000").count() == 4 and pairs.where("a_fid < 1000 and b_fid < 1000").count() == 58 * 58


@pytest.mark.parametrize("seed", range(3))
def test_holes_that_leave_the_tree_are_those_of_one_union(spark, seed):
    """Islands in holes, rings around other units and holes between the pieces of different unions."""
    from cadastra.operators import polygons

    register_geometry(spark)
    rng = random.Random(seed)
    cells = {(x, y) for x in range(26) for y in range(26) if rng.random() > 0.15}
    cells -= {(x, y) for x in range(8, 18) for y in range(8, 18)}
    cells |= {(x, y) for x in range(10, 13) for y in range(10, 13)} - {(11, 11)}
    rows = [f"POLYGON(({x} {y},{x + 1} {y},{x + 1} {y + 1},{x} {y + 1},{x} {y}))" for x, y in cells]
    rows += ["POLYGON((40 0,60 0,60 20,40 20,40 0),(42 2,58 2,58 18,42 18,42 2))"] * 2 + [f"POLYGON(({x} {y},{x + 3} {y + 1},{x + 1} {y + 3},{x} {y}))" for x in range(42, 55, 2) for y in range(2, 15, 3)]
    layer = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "fid long, t string").select("fid", geo("from_text", "t").alias("geom"))
    one = layer.agg(F.collect_list("geom").alias("g")).select(F.explode(geo("holes", geo("union_all", "g"))).alias("geom"))
    inner = one.withColumn("at", geo("inside", "geom")).join(layer.select(F.col("geom").alias("other")), geo("covers", "other", "at"), "left_anti")
    shape = lambda df: sorted((*[round(v, 7) for v in r.b], round(r.a, 7)) for r in df.select(geo("bounds", "geom").alias("b"), geo("area", "geom").alias("a")).collect())
    want = shape(inner)
    assert len(want) > 30
    for fan in (4, 9, 10_000):
        assert shape(polygons.enclosed(layer, fan)) == want
