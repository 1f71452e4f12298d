"""Queries over whole tables against plain Python."""

import pytest
from pyspark.sql import functions as F

from cadastra import catalog
from cadastra.plans.views import view

QUERIES = catalog.queries()
SF = "/root/testdata/sf0.001"


def test_level_pivot_has_every_level(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_linenumber").collect():
        per = want.setdefault(r.l_suppkey, {})
        per[r.l_linenumber] = per.get(r.l_linenumber, 0) + 1
    got = {r.iso: {int(k): int(n) for k, n in (x.split(":") for x in r.levels.split(","))} for r in QUERIES["T15_level_pivot"](spark, SF).collect()}
    assert got == want and {n for v in got.values() for n in v} == set(range(1, 8))


def test_clean_text_keeps_texts_to_repair(spark, tmp_path):
    import hashlib

    cases = {1: (None, None), 2: ("Caf\u00c3\u00a9  del mar ", "Caf\u00e9 del mar"), 7: ("Caf\u00c3\u00a9  del\u00a0mar ", "Caf\u00c3\u00a9 del mar"), 3: ("die Stra\u00df\u201d  hier", "die Stra\u00df\u201d hier"), 4: ("NO\u00cb\u2014 x\u200b", "NO\u00cb\u2014 x"), 5: (" plain  text", "plain text"), 6: ("", "")}
    spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest) for r in QUERIES["U01f_clean_text"](spark, str(tmp_path)).collect()}
    assert got == {k: (None, None) if t is None else (len(t), hashlib.md5(t.encode()).hexdigest()) for k, (_, t) in cases.items()}


def holes(boxes: list[tuple[int, int, int, int]]) -> list[set[tuple[int, int]]]:
    """Empty unit cells enclosed by the boxes, joined by their sides."""
    have = {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}
    xs, ys = [x for x, _ in have], [y for _, y in have]
    left = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - have
    out = []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x, y = todo.pop()
            near = {(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)} & left
            left -= near
            part |= near
            todo += near
        if (min(xs) - 1, min(ys) - 1) not in part:
            out.append(part)
    return out


def boxes_of(spark, name):
    return [tuple(int(v) for v in r) for r in view(spark, SF, name).select("xmin", "ymin", "xmax", "ymax").collect()]


def test_verify_export_counts_gaps(spark):
    b = boxes_of(spark, "units_b")
    overlaps = sum(p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1] for i, p in enumerate(b) for q in b[:i])
    got = {r.kind: r.n for r in QUERIES["G33_verify_export"](spark, SF).collect()}
    assert got == {"invalid": 0, "overlap": overlaps, "gap": len(holes(b))} and got["gap"] > 0


def test_sample_reaches_the_limit_of_the_engine(spark):
    want = sorted({r.adm3_code for r in view(spark, SF, "hier").where("adm3_code is not null").collect()})
    got = [r.adm3_code for r in QUERIES["L04_sorted_sample"](spark, SF).collect()]
    assert 100 < len(want) <= 10_000 and got == want


def test_grid_gaps_of_the_whole_layer(spark):
    want = sorted((len(h), min(x for x, _ in h) * 10, min(y for _, y in h) * 10, max(x for x, _ in h) * 10 + 10, max(y for _, y in h) * 10 + 10) for h in holes([tuple(v // 10 for v in b) for b in boxes_of(spark, "units_a")]))
    got = sorted((r.n_cells, r.xmin, r.ymin, r.xmax, r.ymax) for r in QUERIES["G01_grid_gaps"](spark, SF).collect())
    assert want and got == want


def test_package_lines_with_outlines(spark):
    b = set(boxes_of(spark, "units_a"))
    shared, outline = {1: 0, 2: 0}, []
    for x0, y0, x1, y1 in b:
        east, north = (x0 + 10, y0, x1 + 10, y1) in b, (x0, y0 + 10, x1, y1 + 10) in b
        shared[2] += east + (north and y0 // 40 == (y0 + 10) // 40)
        shared[1] += north and y0 // 40 != (y0 + 10) // 40
        outline.append(4 - east - north - ((x0 - 10, y0, x1 - 10, y1) in b) - ((x0, y0 - 10, x1, y1 - 10) in b))
    got = {r.level: (r.n, r["size"]) for r in QUERIES["G37_package_lines"](spark, SF).collect()}
    assert got == {0: (sum(n > 0 for n in outline), 10.0 * sum(outline))} | {k: (n, 10.0 * n) for k, n in shared.items() if n}


def test_validate_summary_has_gaps_and_micro_units(spark):
    b = boxes_of(spark, "units_b")
    overlaps = sum(p[0] < q[2] and p[2] > q[0] and p[1] < q[3] and p[3] > q[1] for i, p in enumerate(b) for q in b[:i])
    micro = sum(min(x1 - x0, y1 - y0) <= 6 and (x1 - x0) * (y1 - y0) <= 6 * (x1 - x0 + y1 - y0) for x0, y0, x1, y1 in b)
    got = {(r.kind, r.severity): r["count"] for r in QUERIES["N15_validate_summary"](spark, SF).where("stage = 'topology'").collect()}
    assert got == {("overlap", "error"): overlaps, ("gap", "warn"): len(holes(b)), ("micro-polygon", "error"): micro}


def test_width_of_a_rectangle_is_exact(spark):
    """The cells of the middle line of a rectangle all reach the radius: splitting them down to the tolerance gave 10,000s of steps and a width just below the side."""
    from cadastra.functions.geometry import geo, register_geometry

    register_geometry(spark)
    rows = spark.createDataFrame([(20.0, 10.0, 10.0), (30.0, 7.3, 7.3), (1000.0, 0.001, 0.001)], "a double, b double, w double")
    got = rows.select("w", geo("width", geo("box", F.lit(0.0), F.lit(0.0), "a", "b")).alias("width")).collect()
    assert [r.width for r in got] == [pytest.approx(r.w, rel=1e-12) for r in got]


def test_neighbours_follow_each_other_in_unions(spark):
    """A grid of boxes in groups of consecutive places: most edges are shared within a group."""
    from cadastra.functions.geometry import geo, register_geometry

    register_geometry(spark)
    grid = spark.range(1024).selectExpr("cast(id % 32 as double) as x", "cast(floor(id / 32) as double) as y").select(geo("box", "x", "y", F.col("x") + 1, F.col("y") + 1).alias("geom"))
    placed = grid.withColumn("at", geo("place", "geom", F.lit(0.0), F.lit(0.0), F.lit(32.0))).orderBy("at").limit(64).agg(F.collect_list("geom").alias("g"))
    assert placed.select(geo("perimeter", geo("union_all", "g"))).first()[0] == 32.0


def test_known_gaps_are_not_sought_again(spark):
    from cadastra.operators import polygons, workflows
    from cadastra.plans.polygon_queries import layer

    found = polygons.gaps(layer(spark, SF, "units_a"))
    assert workflows.has_gap(None, found=found) and not workflows.has_gap(None, 0.5, found) and workflows.has_gap(None, 10.0, found)


@pytest.mark.parametrize("run", ["clean", "fixed"])
def test_runs_find_gaps_and_overlaps_of_a_layer_once(spark, monkeypatch, run):
    """A clean took the gaps of its input twice and the overlaps of a layer up to three times."""
    from cadastra.operators import polygons, workflows
    from cadastra.plans.polygon_queries import layer

    calls = {"gaps": 0, "overlap_regions": 0}
    for name in calls:
        monkeypatch.setattr(polygons, name, lambda *a, f=getattr(polygons, name), name=name: calls.update({name: calls[name] + 1}) or f(*a))
    units = layer(spark, SF, "units_b").where("fid < 600")
    if run == "clean":
        out = workflows.topo_clean(units)
        assert out["checks"].where("not ok").isEmpty() and out["layer"].count() == units.count()
        found = out["issues"]
    else:
        found = QUERIES["G31_fixed_issues"](spark, SF)
        assert [(r.kind, r.fixed) for r in found.collect()] == [("overlap", True)]
    assert calls == {"gaps": 2, "overlap_regions": 2}  # one layer before, one after
    assert found.where("kind = 'overlap' and not fixed").isEmpty() and not found.where("kind = 'overlap'").isEmpty()


def fails_at(monkeypatch, name, at):
    """A detector that fails on one of its calls."""
    from cadastra.operators import polygons

    calls, detector = [], getattr(polygons, name)

    def run(*a):
        calls.append(name)
        if len(calls) == at:
            raise RuntimeError(f"{name} broke")
        return detector(*a)

    monkeypatch.setattr(polygons, name, run)


@pytest.mark.parametrize("name, at", [("gaps", 1), ("overlap_regions", 1), ("micro_parts", 1), ("micro_parts", 2)])
def test_a_clean_without_a_detector_is_an_error(spark, monkeypatch, name, at):
    """A detector that failed before or after the clean left its issues out, or called them fixed, and the layer came back."""
    from cadastra.operators import workflows
    from cadastra.plans.polygon_queries import layer

    units = layer(spark, SF, "units_b").where("fid < 200")
    fails_at(monkeypatch, name, at)
    with pytest.raises(RuntimeError, match=f"{name} broke"):
        workflows.topo_clean(units)


@pytest.mark.parametrize("name, at", [("gaps", 1), ("gaps", 2), ("overlap_regions", 1), ("overlap_regions", 2), ("micro_parts", 1)])
def test_fixed_issues_without_a_detector_are_an_error(spark, monkeypatch, name, at):
    """No overlaps before looked like a layer without any, no result after like overlaps that are fixed."""
    fails_at(monkeypatch, name, at)
    with pytest.raises(RuntimeError, match=f"{name} broke"):
        QUERIES["G31_fixed_issues"](spark, SF).collect()


def test_a_refused_clean_is_an_error(spark, monkeypatch):
    """The input came back as if it were clean."""
    from cadastra.operators import polygons

    monkeypatch.setattr(polygons, "clean_coverage", lambda layer, width: layer.select("fid", "geom"))
    with pytest.raises(ValueError, match=r"overlaps \(10.0\)"):
        QUERIES["G29_topo_clean"](spark, SF)


def test_kernel_runs_after_rows_are_dealt_out(spark):
    """A layer of one file is one split: repairs and grids are not done before the exchange."""
    from cadastra.operators import polygons
    from cadastra.operators.boxes import judged
    from cadastra.functions.geometry import geo
    from cadastra.plans.polygon_queries import layer

    plan = judged(polygons.spread(layer(spark, SF, "units_b")), "geom", geo("fix", "geom")).where("geom is not null")._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [k for k, line in enumerate(plan) if "geo_fix" in line] and max(k for k, line in enumerate(plan) if "geo_fix" in line) < min(k for k, line in enumerate(plan) if "Exchange" in line)
    assert polygons.bounded(layer(spark, SF, "units_b")).count() == layer(spark, SF, "units_b").count()
