"""Fixture shapes and edge cases of the engine's own operators."""

import random

import pytest
from pyspark.sql import functions as F

from cadastra.functions.text import clean, repair, unaccented
from cadastra.operators import assign, boxes, change, codes, dissolve, graph, hierarchy, names, topology

LAYER = "fid long, code string, name string, xmin double, ymin double, xmax double, ymax double"


def layer(spark, rows):
    return spark.createDataFrame([(i, None, n, *map(float, b)) for i, n, b in rows], LAYER)


A = [(1, "NW", (0, 0, 2, 2)), (2, "Shifted", (2, 0, 4, 2)), (3, "Mid lower", (4, 0, 6, 2)), (4, "Mid upper", (4, 2, 6, 4)), (5, "Big", (6, 0, 10, 2)), (6, "Old", (0, 2, 2, 4))]
B = [(1, "NW", (0, 0, 2, 2)), (2, "Shifted east", (2.3, 0, 4.3, 2)), (7, "Mid merged", (4, 0, 6, 4)), (81, "Big West", (6, 0, 8, 2)), (82, "Big East", (8, 0, 10, 2)), (9, "Brand new", (0, 4, 2, 6))]


def test_change_matrix(spark):
    log = change.compare(layer(spark, A), layer(spark, B)).changelog().collect()
    got = sorted((r.name_a or "", r.name_b or "", r.relationship_class, r.a_in_b, r.b_in_a, r.similarity) for r in log)
    assert got == sorted([
        ("NW", "NW", "unchanged", 1.0, 1.0, 1.0), ("Shifted", "Shifted east", "modified", 0.85, 0.85, 0.739), ("Mid lower", "Mid merged", "merge", 1.0, 0.5, 0.5),
        ("Mid upper", "Mid merged", "merge", 1.0, 0.5, 0.5), ("Big", "Big West", "split", 0.5, 1.0, 0.5), ("Big", "Big East", "split", 0.5, 1.0, 0.5), ("Old", "", "removed", None, None, None), ("", "Brand new", "created", None, None, None),
    ])


def test_change_every_unit_once(spark):
    rng = random.Random(3)
    make = lambda: [(i, None, (x := rng.randint(0, 20), y := rng.randint(0, 20), x + rng.randint(1, 6), y + rng.randint(1, 6))) for i in range(40)]
    a, b = layer(spark, make()), layer(spark, make())
    got = change.compare(a, b).members.groupBy("side", "fid").count().collect()
    assert len(got) == 80 and {r["count"] for r in got} == {1}


def test_empty_layers(spark):
    none = spark.createDataFrame([], LAYER)
    assert boxes.overlap_pairs(none, none).count() == 0
    assert {r.relationship_class for r in change.compare(none, layer(spark, B)).changelog().collect()} == {"created"}


def test_grid_join_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, None, (x := rng.uniform(0, 50), y := rng.uniform(0, 50), x + rng.uniform(0, 9), y + rng.uniform(0, 9))) for i in range(120)]
    df = layer(spark, rows)
    want = {(i, j) for i, _, p in rows for j, _, q in rows if p[0] <= q[2] and p[2] >= q[0] and p[1] <= q[3] and p[3] >= q[1]}
    for cell in (0.7, 5.0, 100.0):
        got = [(r.a_fid, r.b_fid) for r in boxes.box_join(df, df, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_match_modes(spark):
    parent = layer(spark, [(1, None, (0, 0, 10, 10))])
    kids = layer(spark, [(1, None, (1, 1, 4, 4)), (2, None, (5, 1, 8, 4)), (3, None, (1000, 1000, 1010, 1010))])
    rows = lambda mode: sorted((r.input_fid, r.overlay_fid) for r in assign.match_groups(kids, parent, mode=mode).collect())
    assert rows("many") == [(1, 1), (2, 1), (3, -1)]
    assert rows("one") == rows("auto") == [(1, 1), (2, 1), (3, 1)]


def test_fill(spark):
    df = spark.createDataFrame([("A1", "Province A", "A1-01", "District A1"), ("A1", "Province A", None, None), ("B1", "Province B", "B1-01", None)], "adm1_code string, adm1_name string, adm2_code string, adm2_name string")
    got = [(r.adm2_code, r.adm2_name, r.adm_lvl) for r in dissolve.fill_levels(df, [1, 2]).collect()]
    assert got == [("A1-01", "District A1", 2), ("A1", "Province A", 1), ("B1-01", None, 2)]


def test_components_and_matching(spark):
    nodes = spark.range(10).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 6)] + [(8, 9)], "a long, b long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(7)}, 7: 7, 8: 8, 9: 8}
    pairs = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (3, 6)], "a long, b long")
    assert sorted(map(tuple, graph.one_to_one(pairs).collect())) == [(1, 5), (2, 6)]


def test_gap_of_a_ring(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4) or (x, y) == (2, 2)]
    got = topology.grid_gaps(spark.createDataFrame(ring, "cx long, cy long"), 1.0).collect()
    assert [(r.n_cells, r.xmin, r.ymax) for r in got] == [(8, 1.0, 4.0)]
    assert topology.grid_gaps(spark.createDataFrame(ring[1:][:3], "cx long, cy long"), 1.0).count() == 0


def test_codes():
    assert codes.parse_width("auto") == "auto" and codes.parse_width("2,3") == [2, 3]
    with pytest.raises(ValueError):
        codes.parse_width("0")
    assert codes.detect_format(["AF-01-002", "AF-02-010"]) == codes.CodeFormat("AF", "-", [2, 3])
    assert codes.detect_format(["AF01"]) is None


def test_padding_never_cuts(spark):
    assert [r[0] for r in spark.range(98, 102).select(codes.padded(F.col("id"), 2)).collect()] == ["98", "99", "100", "101"]


def test_crosswalk_errors():
    for rows in ([("a", "x"), ("a", "y")], [("a", "x"), ("b", "x")], [("a", "x")], [("a", "FID"), ("b", "y")]):
        with pytest.raises(ValueError):
            dissolve.validate_crosswalk(["a", "b"], rows)


def test_text():
    assert repair("SÃ£o") == "São" and repair("São") is None and clean("  SÃ£o  Paulo ") == "São Paulo" and clean("a\u200bb\u00a0c") == "ab c" and unaccented("Éàç") == "Eac" and clean(None) is None


def test_infer_levels(spark):
    df = spark.createDataFrame([(f"R{i % 3}", f"Reg {'abc'[i % 3]}", f"R{i % 3}-{i % 12}", f"D{'xyzuvwrstopq'[i % 12]}", i) for i in range(60)], "rc string, rn string, dc string, dn string, v long")
    chain = hierarchy.infer_levels(df, ["rc", "rn", "dc", "dn"])
    assert [sorted(lv.columns) for lv in chain] == [["rc", "rn"], ["dc", "dn"]] and chain[0].codes == ["rc"] and chain[1].names == ["dn"]


def test_checks_on_an_empty_table(spark):
    none = spark.createDataFrame([], "level int, name_column string, name_index int, code_column string, code string, parent_code string, name string, row_count long")
    assert names.run_checks(none).count() == 0 and codes.check_codes(none).count() == 0


def test_code_update(spark):
    from cadastra.operators.update import update_level

    coded = "fid long, code string, name string, xmin double, ymin double, xmax double, ymax double"
    old = spark.createDataFrame([(i, f"X-{i:02d}", n, *map(float, b)) for i, n, b in A], coded)
    new = layer(spark, B)
    parents = new.select("fid", F.lit("X").alias("parent_code"))
    got = {(r.new_fid, r.old_code): (r.new_code, r.outcome) for r in update_level(old, new, parents, codes.CodeFormat("X", "-", 2)).collect()}
    assert got[(1, "X-01")] == ("X-01", "retained")
    assert {k for k, v in got.items() if v[1] == "retired"} == {(None, "X-03"), (None, "X-04"), (None, "X-06")}
    fresh = {k: v[0] for k, v in got.items() if v[1] == "new"}
    assert set(fresh) == {(2, "X-02"), (7, None), (81, "X-05"), (82, "X-05"), (9, None)} and sorted(fresh.values()) == [f"X-{n:02d}" for n in range(7, 12)]
