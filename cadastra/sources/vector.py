"""Readers of vector files that are one value each: GeoPackage, KML, GML and GPX.

A file is read by one task, on an executor, from any store that Spark reads;
folders of files are read side by side. Every feature is a row: its geometry as
WKB, its attributes as text by name.
"""

from __future__ import annotations

import json
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.shipping import ship
from cadastra.sources.layers import wkb_of, with_fid

Feature = tuple[bytes | None, dict[str, str | None]]


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage blob: its header has a box of 0, 4, 6 or 8 numbers."""
    if not blob or blob[:2] != b"GP":
        return None
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


def read_gpkg(data: bytes, layer: str | None = None) -> Iterator[Feature]:
    """Features of one layer of a GeoPackage, the first by name unless it is given."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        table, shape = next((x for x in layers if layer in (None, x[0])), (None, None))
        if table is None:
            return
        quoted = table.replace('"', '""')
        rows = db.execute(f'SELECT * FROM "{quoted}"')
        names = [c[0] for c in rows.description]
        key = next((r[1] for r in db.execute(f'PRAGMA table_info("{quoted}")') if r[5]), None)
        for row in rows:
            own = dict(zip(names, row))
            yield gpkg_wkb(own.pop(shape)), {k: None if v is None else str(v) for k, v in own.items() if k != key and not isinstance(v, bytes)}
    finally:
        db.close()


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _all(element: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in element.iter() if _name(e) == name]


def _child(element: ET.Element, *names: str) -> ET.Element | None:
    return next((e for e in element if _name(e) in names), None)


def _numbers(text: str | None, dimension: int) -> list[list[float]]:
    flat = [float(x) for x in re.split(r"[\s,]+", text or "") if x]
    return [flat[k : k + 2] for k in range(0, len(flat) - dimension + 1, dimension)]


def _points(element: ET.Element) -> list[list[float]]:
    """Coordinates of the first coordinate element: KML tuples, GML lists, or GML positions."""
    for e in element.iter():
        kind = _name(e)
        if kind == "coordinates":
            return [[float(x) for x in t.split(",")[:2]] for t in (e.text or "").split()]
        if kind in ("posList", "pos"):
            dimension = int(e.get("srsDimension") or element.get("srsDimension") or 2)
            many = [p for x in ([e] if kind == "posList" else _all(element, "pos")) for p in _numbers(x.text, dimension)]
            return many
    return []


_MULTI = {"MultiGeometry", "MultiPolygon", "MultiSurface", "MultiLineString", "MultiCurve", "MultiPoint"}


def _shape(element: ET.Element) -> dict | None:
    """GeoJSON of a KML or GML geometry element."""
    kind = _name(element)
    if kind == "Point":
        at = _points(element)
        return {"type": "Point", "coordinates": at[0]} if at else None
    if kind in ("LineString", "Curve", "LinearRing"):
        return {"type": "LineString", "coordinates": _points(element)}
    if kind in ("Polygon", "Surface"):
        rings = [e for e in element.iter() if _name(e) in ("outerBoundaryIs", "exterior")] + [e for e in element.iter() if _name(e) in ("innerBoundaryIs", "interior")]
        return {"type": "Polygon", "coordinates": [r for e in rings for ring in _all(e, "LinearRing") for r in [_points(ring)] if r]}
    if kind in _MULTI:
        members = [e for c in element for e in ([c] if _name(c) in _SHAPES else list(c)) if _name(e) in _SHAPES]
        parts = [p for p in map(_shape, members) if p]
        kinds = {p["type"] for p in parts}
        if len(kinds) == 1 and not kinds & {"GeometryCollection"} and not next(iter(kinds)).startswith("Multi"):
            return {"type": f"Multi{kinds.pop()}", "coordinates": [p["coordinates"] for p in parts]}
        return {"type": "GeometryCollection", "geometries": parts} if parts else None
    return None


_SHAPES = {"Point", "LineString", "Curve", "Polygon", "Surface"} | _MULTI


def read_kml(data: bytes) -> Iterator[Feature]:
    """Placemarks: name, description and extended data."""
    for mark in _all(ET.fromstring(data), "Placemark"):
        shape = next((e for e in mark if _name(e) in _SHAPES), None)
        values = {_name(e): e.text for e in mark if _name(e) in ("name", "description")}
        values |= {e.get("name"): e.text for e in _all(mark, "SimpleData")}
        values |= {e.get("name"): (v.text if (v := _child(e, "value")) is not None else None) for e in _all(mark, "Data")}
        yield wkb_of(_shape(shape)) if shape is not None else None, values


def read_gml(data: bytes) -> Iterator[Feature]:
    """Members of a feature collection; properties are their elements with text alone."""
    for member in (e for e in ET.fromstring(data).iter() if _name(e) in ("featureMember", "member", "featureMembers")):
        for feature in member:
            shape = next((e for p in feature for e in p if _name(e) in _SHAPES), None)
            yield wkb_of(_shape(shape)) if shape is not None else None, {_name(e): e.text for e in feature if not len(e)}


def read_gpx(data: bytes) -> Iterator[Feature]:
    """Waypoints, routes and tracks (one line for each segment)."""
    at = lambda e: [float(e.get("lon")), float(e.get("lat"))]
    for e in ET.fromstring(data):
        kind = _name(e)
        shape = {"wpt": lambda e: {"type": "Point", "coordinates": at(e)}, "rte": lambda e: {"type": "LineString", "coordinates": [at(p) for p in _all(e, "rtept")]}, "trk": lambda e: {"type": "MultiLineString", "coordinates": [[at(p) for p in _all(s, "trkpt")] for s in _all(e, "trkseg")]}}.get(kind)
        if shape:
            yield wkb_of(shape(e)), {"kind": kind} | {_name(c): c.text for c in e if _name(c) in ("name", "desc", "ele", "time")}


READERS: dict[str, Callable[[bytes], Iterator[Feature]]] = {"geopackage": read_gpkg, "kml": read_kml, "gml": read_gml, "gpx": read_gpx}


def _features(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held: list[Feature] = []
                for feature in READERS[kind](data.as_py()):
                    held.append(feature)
                    if len(held) == 1000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return run


def _batch(rows: list[Feature]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.binary()), pa.array([json.dumps(p) for _, p in rows], pa.string())], names=["geom", "properties"])


def read_vector(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A layer (fid, geom, attributes as text) of a file, or a folder of files, of one kind."""
    if kind not in READERS:
        raise NotImplementedError(f"no reader for {kind}")
    ship(spark)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_features(kind), "geom binary, properties string")
    rows = rows.withColumn("p", F.from_json("properties", "map<string,string>"))
    names = sorted(r.k for r in rows.select(F.explode(F.map_keys("p")).alias("k")).distinct().collect())  # attribute names
    return with_fid(rows.select("geom", *[F.col("p")[n].alias(n) for n in names]))
