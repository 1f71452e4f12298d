"""Reading layers: format choice, attributes apart from geometry, stable ids, extent.

A layer is read as one DataFrame with fid, geom (WKB) and its attributes.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from cadastra.functions.geometry import geo
from cadastra.shipping import ship

FORMATS = {
    "parquet": "parquet", "geoparquet": "parquet", "geojson": "geojson", "json": "geojson", "geojsonl": "geojsonl", "geojsons": "geojsonl", "ndjson": "geojsonl", "shp": "shapefile", "dbf": "shapefile", "shx": "shapefile",
    "prj": "shapefile", "cpg": "shapefile", "csv": "csv", "zip": "zip", "gpkg": "geopackage", "fgb": "flatgeobuf", "kml": "kml", "gml": "gml", "gpx": "gpx",
}
PRIORITY = ("shapefile", "parquet")


def format_of(name: str) -> str | None:
    """The format of a file by its extension, in any case; None if it is not known."""
    m = re.search(r"\.([A-Za-z0-9]+)$", name.rstrip("/"))
    return FORMATS.get(m[1].lower()) if m else None


def sniff_format(head: bytes) -> str | None:
    """The format of a file by its first bytes; raises ValueError for a web page."""
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"PK\x03\x04"):
        return "zip"
    if head.startswith(b"SQLite format 3\x00"):
        return "geopackage"
    if head.startswith(b"fgb"):
        return "flatgeobuf"
    if head[:4] == struct.pack(">i", 9994):
        return "shapefile"
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")[:200].lower()
    if text.startswith((b"<!doctype html", b"<html")):
        raise ValueError("the source is a web page")
    if text.startswith(b"{"):
        return "geojson"
    for mark, kind in ((b"<kml", "kml"), (b"<gpx", "gpx"), (b"featurecollection", "gml")):
        if mark in text:
            return kind
    return None


def choose(names: list[str]) -> list[str]:
    """Which files of a set form the layer: a shapefile's members, else Parquet files, else the first known one."""
    known = [n for n in names if format_of(n)]
    for kind in PRIORITY:
        group = [n for n in known if format_of(n) == kind]
        if group:
            return group
    return known[:1]


def expand_zip(data: bytes) -> dict[str, bytes]:
    """Members of an archive by their inner path, without resource forks and empty entries."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/") and i.file_size}


def with_fid(df: DataFrame, name: str = "fid") -> DataFrame:
    """df with a dense id from 1 in row order of its files, in the JVM.

    A row's place in its partition comes from the id that Spark gives it; the
    sizes of the partitions before it are a small table.
    """
    if name in df.columns:
        df = df.withColumnRenamed(name, f"{name}_orig")
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_ahead"))  # a row for each partition
    number = F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(ahead), "_part").withColumn(name, number).drop("_at", "_part", "_ahead")


def geometry_column(df: DataFrame, metadata: dict | None = None) -> str | None:
    """The geometry column: by metadata, else the first binary column with a usual name, else the first binary one."""
    if metadata and metadata.get("primary_column") in df.columns:
        return metadata["primary_column"]
    binary = [f.name for f in df.schema if isinstance(f.dataType, BinaryType)]
    usual = [c for c in binary if re.fullmatch(r"(wkb_?)?(geom(etry)?|the_geom|shape|wkb)", c, re.I)]
    return next(iter(usual + binary), None)


def attributes(df: DataFrame, geometry: str) -> DataFrame:
    """df without other geometry columns and without bounding-box structs."""
    drop = [f.name for f in df.schema if f.name != geometry and (isinstance(f.dataType, BinaryType) or (isinstance(f.dataType, StructType) and re.fullmatch(r"(.*_)?bbox", f.name)))]
    return df.drop(*drop)


def geo_metadata(spark: SparkSession, path: str) -> dict | None:
    """The `geo` entry of a Parquet footer (of the first file of a folder), from any store that Spark reads; None if there is none or it is not JSON."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    if store.getFileStatus(at).isDirectory():
        files = sorted((f.getPath().toString() for f in store.listStatus(at) if f.getPath().getName().endswith(".parquet")))
        if not files:
            return None
        at = jvm.org.apache.hadoop.fs.Path(files[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def read_parquet_layer(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    column = geometry_column(df, geo_metadata(spark, path))
    if column is None:
        raise ValueError("no geometry column")
    df = with_fid(attributes(df, column).withColumnRenamed(column, "geom"))
    return df.withColumn("geom", geo("fix", "geom"))


def wkb_of(g: dict | None) -> bytes | None:
    """WKB of a GeoJSON geometry, in two dimensions."""
    if not g:
        return None
    kinds = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
    kind = kinds.get(g.get("type"))
    if kind is None:
        return None
    point = lambda p: struct.pack("<2d", p[0], p[1])
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(map(point, ps))
    poly = lambda rs: struct.pack("<I", len(rs)) + b"".join(map(line, rs))
    head = struct.pack("<BI", 1, kind)
    c = g.get("coordinates")
    if kind == 1:
        return head + point(c) if c else None
    if kind in (2, 3):
        return head + (line if kind == 2 else poly)(c)
    parts = g["geometries"] if kind == 7 else [{"type": g["type"][5:], "coordinates": x} for x in c]
    return head + struct.pack("<I", len(parts)) + b"".join(wkb_of(p) for p in parts)


def _geojson_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(wkb_of(json.loads(g) if g else None), p) for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([p for _, p in out], pa.string())], names=["geom", "properties"])


def read_geojson(spark: SparkSession, path: str, *, lines: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Features as rows: properties become columns (text but for numbers and booleans); OGC_FID becomes OGC_FID_orig.

    A feature collection is one JSON value, so it is read by one task; feature
    lines are read in parallel.
    """
    ship(spark)
    text = spark.read.text(path, wholetext=not lines)
    feature = "struct<geometry:string,properties:string>"
    if lines:
        f = text.select(F.from_json("value", feature).alias("f"))
    else:
        f = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<{feature}>")).alias("f"))
    rows = f.select("f.geometry", "f.properties").mapInArrow(_geojson_rows, "geom binary, properties string")
    if columns is None:
        kinds = {r.k: r.t for r in rows.select(F.explode(F.from_json("properties", "map<string,string>")).alias("k", "v")).groupBy("k").agg(F.when(F.bool_and(F.col("v").isNull() | F.col("v").rlike(r"^-?\d{1,18}$")), "bigint").when(F.bool_and(F.col("v").isNull() | F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), "double").otherwise("string").alias("t")).orderBy("k").collect()}
    else:
        kinds = dict.fromkeys(columns, "string")
    rows = rows.withColumn("p", F.from_json("properties", "map<string,string>"))
    named = [F.col("p")[k].cast(t).alias("OGC_FID_orig" if k.upper() == "OGC_FID" else k) for k, t in kinds.items()]
    return with_fid(rows.select("geom", *named))


def read_shapefile(shp: bytes, dbf: bytes | None = None) -> list[dict]:
    """Records of a shapefile's members: geom (WKB of points, lines and polygons) and the attributes of the table."""
    rows, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">i", shp, at + 4)[0] * 2
        body = shp[at + 8 : at + 8 + size]
        rows.append({"geom": wkb_of(_shape(body))})
        at += 8 + size
    if dbf:
        for row, values in zip(rows, _table(dbf)):
            row.update(values)
    return rows


def _shape(body: bytes) -> dict | None:
    kind = struct.unpack_from("<i", body)[0] % 10
    if kind == 1:
        return {"type": "Point", "coordinates": list(struct.unpack_from("<2d", body, 4))}
    if kind not in (3, 5):
        return None
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    xy = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
    rings = [[[xy[2 * i], xy[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:])]
    if kind == 3:
        return {"type": "MultiLineString", "coordinates": rings}
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))
    polys: list = []
    for r in rings:  # outer rings run clockwise, and their holes follow
        if area(r) <= 0 or not polys:
            polys.append([r])
        else:
            polys[-1].append(r)
    return {"type": "MultiPolygon", "coordinates": polys}


def _table(dbf: bytes) -> Iterator[dict]:
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at, place = [], 32, 1
    while dbf[at] != 0x0D:
        name, kind, width = dbf[at : at + 11].split(b"\0")[0].decode(), chr(dbf[at + 11]), dbf[at + 16]
        fields.append((name, kind, place, width, dbf[at + 17]))
        at, place = at + 32, place + width
    for k in range(n):
        record = dbf[head + k * size : head + (k + 1) * size]
        out = {}
        for name, kind, a, width, decimals in fields:
            text = record[a : a + width].decode("utf-8", "replace").strip()
            out[name] = None if not text else (float(text) if decimals else int(text)) if kind in "NF" and re.fullmatch(r"[-+.\dEe]+", text) else text
        yield out


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """A layer from a path, by its format."""
    kind = format_of(path)
    if kind == "parquet":
        return read_parquet_layer(spark, path)
    if kind in ("geojson", "geojsonl"):
        return read_geojson(spark, path, lines=kind == "geojsonl")
    if kind == "shapefile":
        stem = re.sub(r"\.[^.]+$", "", path)
        files = {r.path.lower(): bytes(r.content) for r in spark.read.format("binaryFile").load(f"{stem}.*").select("path", "content").collect()}  # the members of one layer
        pick = lambda e: next((v for k, v in files.items() if k.endswith(e)), None)
        rows = read_shapefile(pick(".shp"), pick(".dbf"))
        names = sorted({k for r in rows for k in r} - {"geom"})
        kinds = {n: "double" if any(isinstance(r.get(n), float) for r in rows) else "bigint" if all(r.get(n) is None or isinstance(r[n], int) for r in rows) else "string" for n in names}
        values = [(i + 1, r["geom"], *(None if r.get(n) is None else float(r[n]) if kinds[n] == "double" else r[n] if kinds[n] == "bigint" else str(r[n]) for n in names)) for i, r in enumerate(rows)]
        return spark.createDataFrame(values, ", ".join(["fid bigint", "geom binary", *(f"`{n}` {kinds[n]}" for n in names)]))
    from cadastra.sources.vector import READERS, read_vector

    if kind in READERS:
        return read_vector(spark, path, kind)
    raise NotImplementedError(f"no reader for {path}")


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table: header, all text, quoted fields with doubled quotes and line breaks; blank rows go. A missing file gives schema without rows."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    try:
        df = reader.csv(path)
    except Exception as e:
        if schema and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.where(F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(1)) for c in df.columns]).isNotNull())
