"""Vector files of one value each, written by hand here and read through Spark."""

import sqlite3
import struct

import pytest

from cadastra.functions.geometry import geo, register_geometry
from cadastra.sinks.layers import with_geometry, zip_outputs
from cadastra.sources.layers import expand_zip, read_layer, wkb_of

KML = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>A</name><ExtendedData><SchemaData><SimpleData name="code">x1</SimpleData></SchemaData><Data name="n"><value>5</value></Data></ExtendedData>
<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,9 4,0 4,4 0,4 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>B</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><Point><coordinates>3,4</coordinates></Point></MultiGeometry></Placemark><Placemark><name>C</name></Placemark></Document></kml>"""
GML = """<c xmlns:gml="http://www.opengis.net/gml"><gml:featureMember><u><code>k</code><geom><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 2 0 2 2 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></geom></u></gml:featureMember>
<gml:featureMember><u><code>p</code><geom><gml:Point srsDimension="3"><gml:pos>5 6 7</gml:pos></gml:Point></geom></u></gml:featureMember></c>"""
GPX = """<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="2" lon="1"><name>w</name></wpt><trk><name>t</name><trkseg><trkpt lat="0" lon="0"/><trkpt lat="1" lon="1"/></trkseg></trk></gpx>"""


def package(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('units', 'shape')")
    db.execute("CREATE TABLE units (fid INTEGER PRIMARY KEY, shape BLOB, code TEXT, n INTEGER)")
    point = wkb_of({"type": "Point", "coordinates": [3, 4]})
    header = b"GP\0" + bytes([0b11]) + struct.pack("<i", 4326) + struct.pack("<4d", 3, 3, 4, 4)
    db.executemany("INSERT INTO units VALUES (?, ?, ?, ?)", [(7, header + point, "a", 1), (9, None, None, 2)])
    db.commit()
    db.close()


def rows(df):
    return sorted((tuple(r) for r in df.select(geo("to_text", "geom").alias("t"), *[c for c in df.columns if c not in ("geom", "fid")]).collect()), key=str)


@pytest.mark.parametrize("kind", ["kml", "gml", "gpx", "gpkg"])
def test_reader(spark, tmp_path, kind):
    register_geometry(spark)
    path = tmp_path / f"a.{kind}"
    if kind == "gpkg":
        package(path)
    else:
        path.write_text({"kml": KML, "gml": GML, "gpx": GPX}[kind])
    got = rows(read_layer(spark, f"file://{path}"))
    want = {
        "kml": [("MULTIPOINT ((1 2), (3 4))", None, None, "B"), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "x1", "5", "A"), (None, None, None, "C")],
        "gml": [("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)))", "k"), ("POINT (5 6)", "p")],
        "gpx": [("MULTILINESTRING ((0 0, 1 1))", "trk", "t"), ("POINT (1 2)", "wpt", "w")],
        "gpkg": [("POINT (3 4)", "a", "1"), (None, None, "2")],
    }[kind]
    assert got == sorted(want, key=str)


def test_table_with_geometry_and_archive(spark):
    layer = spark.createDataFrame([(1, b"g1"), (2, b"g2")], "fid long, geom binary")
    table = spark.createDataFrame([(2, "x"), (3, "y")], "fid long, v string")
    out = with_geometry(table, layer)
    assert out.columns == ["geom", "fid", "v"] and {(r.fid, r.geom and bytes(r.geom)) for r in out.collect()} == {(2, b"g2"), (3, None)}
    assert expand_zip(zip_outputs({"b.csv": b"1", "a/x.txt": b"2"})) == {"a/x.txt": b"2", "b.csv": b"1"}
