"""Writing layers and reports."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, MapType, StructType

from cadastra.functions.geometry import geo


@dataclass(frozen=True)
class OutputSpec:
    """One output: its file suffix, kind (spatial or tabular), columns (all if None), and order."""

    suffix: str
    kind: str = "spatial"
    columns: tuple[str, ...] | None = None
    order: str | None = None


#: Formats that a layer, or a table, can be written to.
CAPABILITIES = {"parquet": ("spatial", "tabular"), "geojsonl": ("spatial",), "csv": ("tabular",)}


def formats_for(kind: str) -> list[str]:
    return [f for f, kinds in CAPABILITIES.items() if kind in kinds]


def select_output(df: DataFrame, spec: OutputSpec) -> DataFrame:
    """The columns of an output, without fid and row order, in that order."""
    out = df.orderBy("__row_order") if "__row_order" in df.columns else df.orderBy(F.col(spec.order).asc_nulls_last()) if spec.order else df
    return out.select(*spec.columns) if spec.columns else out.drop("fid", "__row_order", "xmin", "ymin", "xmax", "ymax")


def exportable(df: DataFrame) -> DataFrame:
    """df with columns that exchange formats lack (nested, binary, wide decimals) as text."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name == "geom":
            cols.append(c)
        elif isinstance(f.dataType, (StructType, ArrayType, MapType)):
            cols.append(F.to_json(c).alias(f.name))
        elif isinstance(f.dataType, (BinaryType, DecimalType)):
            cols.append((F.hex(c) if isinstance(f.dataType, BinaryType) else c.cast("string")).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def features(layer: DataFrame) -> DataFrame:
    """One GeoJSON feature a row, in column value; rows without geometry go. The ring text of the kernel becomes coordinates by replacement alone."""
    df = exportable(layer)
    text = geo("to_text", "geom")
    kind = F.regexp_extract("_t", r"^([A-Z]+)", 1)
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    body = F.regexp_replace("_t", r"^[A-Z]+ ", "")
    pairs = F.regexp_replace(body, r"(-?[\d.]+(?:E-?\d+)?) (-?[\d.]+(?:E-?\d+)?)", "[$1,$2]")
    coordinates = F.translate(F.regexp_replace(pairs, r"\[([^\[\]]*)\]", "{$1}"), "(){}", "[][]")
    coordinates = F.when(kind.isin("POINT"), F.regexp_extract(coordinates, r"^\[(.*)\]$", 1)).otherwise(coordinates)
    names_map = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    props = F.to_json(F.struct(*[f"`{c}`" for c in df.columns if c != "geom"]), {"ignoreNullFields": "false"})
    df = df.withColumn("_t", text).where("_t is not null")
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), names_map[kind], F.lit('","coordinates":'), coordinates, F.lit("}}")).alias("value"))


def write_layer(layer: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a layer as Parquet (zstd) or as GeoJSON lines."""
    if fmt == "parquet":
        layer.write.option("compression", "zstd").parquet(path)
    elif fmt == "geojsonl":
        features(layer).write.text(path)
    else:
        raise NotImplementedError(f"no writer for {fmt}")


def with_geometry(table: DataFrame, layer: DataFrame, key: str = "fid") -> DataFrame:
    """A table with the geometry of its units as first column, for Parquet; rows without a unit keep a null."""
    shapes = layer.select(F.col(key).alias("_key"), F.col("geom"))
    return table.join(shapes, F.col(key) == F.col("_key"), "left").select("geom", *table.columns)


def zip_outputs(outputs: dict[str, bytes]) -> bytes:
    """One archive of written files (a download of an export: what fits a reply)."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(outputs.items()):
            z.writestr(name, data)
    return held.getvalue()


def write_report(df: DataFrame, path: str) -> None:
    """A CSV report with header; the first column's name carries a byte-order mark, so spreadsheets read it as UTF-8."""
    names = list(df.columns)
    exportable(df).toDF("﻿" + names[0], *names[1:]).coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def changed(result: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of result whose geometry differs from the one before: bytes, then vertex counts, then shape."""
    both = result.join(before.select("fid", F.col("geom").alias("_old")), "fid", "left")
    same = F.when(F.col("geom") == F.col("_old"), True).when(geo("points", "geom") != geo("points", "_old"), geo("equal", "geom", "_old")).otherwise(geo("equal", "geom", "_old"))
    return both.where(~F.coalesce(same, F.lit(False))).drop("_old")
