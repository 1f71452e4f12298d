"""Sources, sinks and the geometry kernel."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cadastra.functions.geometry import geo, kernel_available, register_geometry
from cadastra.operators import polygons
from cadastra.sinks import layers as sinks
from cadastra.sources import layers as sources

pytestmark = pytest.mark.skipif(not kernel_available(), reason="needs javac")


@pytest.fixture(scope="module")
def kernel(spark):
    register_geometry(spark)
    return spark


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]


def layer(spark, boxes):
    rows = [(i, sources.wkb_of({"type": "Polygon", "coordinates": box(*b)})) for i, b in boxes]
    return polygons.bounded(spark.createDataFrame(rows, "fid long, geom binary"))


def test_geojson_round_trip(kernel, tmp_path):
    features = [{"type": "Feature", "properties": {"id": k, "name": f"n{k}", "OGC_FID": 7}, "geometry": {"type": "Polygon", "coordinates": box(k, 0, k + 1, 1)}} for k in range(3)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = sources.read_layer(kernel, str(tmp_path / "a.geojson"))
    assert sorted(df.columns) == sorted(["geom", "OGC_FID_orig", "id", "name", "fid"]) and [r.fid for r in df.orderBy("fid").collect()] == [1, 2, 3]
    sinks.write_layer(df.drop("fid"), str(tmp_path / "out.geojsonl"), "geojsonl")
    again = sources.read_layer(kernel, str(tmp_path / "out.geojsonl"))
    key = lambda d: sorted((r.id, r.name, r.t) for r in d.select("id", "name", geo("to_text", "geom").alias("t")).collect())
    assert key(df) == key(again)


def test_parquet_and_report(kernel, tmp_path):
    df = layer(kernel, [(1, (0, 0, 1, 1))]).withColumn("name", F.lit('say "hi",\nthere'))
    sinks.write_layer(df.select("geom", "name"), str(tmp_path / "x.parquet"))
    assert sources.read_layer(kernel, str(tmp_path / "x.parquet")).select("fid", "name").collect() == [(1, 'say "hi",\nthere')]
    sinks.write_report(df.select("name", "fid"), str(tmp_path / "r"))
    assert [(r.name, r.fid) for r in sources.read_table(kernel, str(tmp_path / "r")).collect()] == [('say "hi",\nthere', "1")]
    assert sources.read_table(kernel, str(tmp_path / "none.csv"), "a string").count() == 0


def test_shapefile():
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = bytes(100) + struct.pack(">2i", 1, len(body) // 2) + body
    dbf = struct.pack("<4BIHH20x", 3, 0, 0, 0, 1, 65, 6) + b"code".ljust(11, b"\0") + b"C" + bytes(4) + bytes([5, 0]) + bytes(14) + b"\r" + b" ab12 "
    assert sources.read_shapefile(shp, dbf) == [{"geom": sources.wkb_of({"type": "MultiPolygon", "coordinates": [[list(map(list, ring))]]}), "code": "ab12"}]


def test_choice_of_files():
    assert sources.choose(["a.csv", "b.PARQUET", "c.shp", "c.dbf"]) == ["c.shp", "c.dbf"] and sources.choose(["x.txt", "a.geojson", "b.kml"]) == ["a.geojson"]
    assert sources.sniff_format(b"PAR1...") == "parquet" and sources.sniff_format(b' {"type"') == "geojson" and sources.sniff_format(struct.pack(">i", 9994)) == "shapefile"
    with pytest.raises(ValueError):
        sources.sniff_format(b"<!DOCTYPE html><p>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("in/a.csv", "x")
        z.writestr("__MACOSX/a.csv", "y")
        z.writestr("empty.csv", "")
    assert sources.expand_zip(data.getvalue()) == {"in/a.csv": b"x"}


def test_clean_coverage(kernel):
    units = layer(kernel, [(1, (10, 48, 11.0001, 49)), (2, (11, 48, 12, 49)), (3, (12.001, 48, 13, 49)), (4, (10, 49, 11.0001, 50)), (5, (11, 49, 12, 50)), (6, (12.001, 49, 13, 50))])
    found = polygons.overlap_regions(units).collect()
    assert {(r.unit_a, r.unit_b) for r in found} == {(1, 2), (4, 5)} and polygons.gaps(units).count() == 0
    done = polygons.bounded(polygons.stitch(units))
    assert polygons.overlap_regions(done).count() == 0
    assert done.agg(F.sum(geo("area", "geom"))).first()[0] == pytest.approx(5.998)


def test_gap_is_filled(kernel):
    ring = [(1, (0, 0, 3, 1)), (2, (0, 1, 1, 2)), (3, (2, 1, 3, 2)), (4, (0, 2, 3, 3))]
    units = layer(kernel, ring)
    (gap,) = polygons.gaps(units).collect()
    assert gap.width == pytest.approx(1.0, abs=1e-3)
    done = polygons.clean_coverage(units, 1.1)
    assert done.agg(F.sum(geo("area", "geom"))).first()[0] == pytest.approx(9.0) and polygons.eroded(units, done).count() == 0


def test_clip_fixture(kernel):
    parent = layer(kernel, [(1, (0, 0, 10, 10))])
    kids = layer(kernel, [(1, (1, 1, 3, 3)), (2, (10, 4, 12, 6)), (7, (9, 7, 12, 9))])
    out, issues = polygons.clip(kids, parent)
    assert {r.fid: r.a for r in out.select("fid", geo("area", "geom").alias("a")).collect()} == {1: 4.0, 7: 2.0}
    assert [(r.kind, r.fid) for r in issues.collect()] == [("clip-empty", 2)]


def test_extent(kernel):
    with pytest.raises(ValueError):
        polygons.check_extent(layer(kernel, [(1, (995, 995, 1005, 1005))]))
