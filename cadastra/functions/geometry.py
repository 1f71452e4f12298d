"""The geometry kernel: JVM functions over WKB, compiled once from Geo.java.

No Python worker takes part: the functions run in the executors' JVMs over the
geometry library on Spark's own class path.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.storage import stored

#: SQL name: (class, return type).
FUNCTIONS = {
    "geo_area": ("Area", "double"), "geo_perimeter": ("Perimeter", "double"), "geo_points": ("Points", "int"), "geo_valid": ("Valid", "boolean"), "geo_bounds": ("Bounds", "array<double>"),
    "geo_fix": ("Fix", "binary"), "geo_from_text": ("FromText", "binary"), "geo_to_text": ("ToText", "string"), "geo_parts": ("Parts", "array<binary>"), "geo_holes": ("Holes", "array<binary>"),
    "geo_inside": ("Inside", "binary"), "geo_width": ("Width", "double"), "geo_centre": ("Centre", "binary"), "geo_boundary": ("Boundary", "binary"), "geo_merge_lines": ("MergeLines", "binary"),
    "geo_intersection": ("Intersection", "binary"), "geo_shared_line": ("SharedLine", "binary"), "geo_difference": ("Difference", "binary"), "geo_overlaps": ("Overlaps", "boolean"), "geo_touches": ("Touches", "boolean"),
    "geo_intersects": ("Intersects", "boolean"), "geo_covers": ("Covers", "boolean"), "geo_equal": ("EqualShape", "boolean"), "geo_buffer": ("Buffer", "binary"), "geo_on_grid": ("OnGrid", "binary"),
    "geo_distance": ("Distance", "double"), "geo_union_all": ("UnionAll", "binary"), "geo_invalid_edges": ("InvalidEdges", "int"), "geo_equal_area": ("EqualArea", "binary"),
    "geo_contact": ("Contact", "double"), "geo_segments": ("Segments", "array<double>"), "geo_sample": ("Sample", "array<double>"), "geo_territories": ("Territories", "array<binary>"),
    "geo_place": ("Place", "long"), "geo_box": ("Box", "binary"), "geo_shells": ("Shells", "array<binary>"), "geo_apart": ("Apart", "array<binary>"), "geo_gaps": ("Gaps", "array<binary>"), "geo_without": ("Without", "binary"),
}
_registered: set[str] = set()


def kernel_available() -> bool:
    return shutil.which("javac") is not None


def _jar(spark: SparkSession) -> str:
    """Compile Geo.java against Spark's jars into a jar of this process's own folder."""
    import pyspark

    home = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent)
    folder = Path(tempfile.mkdtemp(prefix="cadastra-geo-"))
    source = folder / "Geo.java"
    source.write_text((Path(__file__).parent / "Geo.java").read_text())
    subprocess.run(["javac", "-nowarn", "-cp", str(home / "jars" / "*"), "-d", str(folder / "classes"), str(source)], check=True, capture_output=True, text=True)
    jar = folder / "cadastra-geo.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for c in sorted((folder / "classes").rglob("*.class")):
            out.write(c, c.relative_to(folder / "classes"))
    return str(jar)


def register_geometry(spark: SparkSession) -> None:
    """Make the geo_ functions known to a session; raises NotImplementedError without a Java compiler."""
    app = spark.sparkContext.applicationId
    if app in _registered:
        return
    if not kernel_available():
        raise NotImplementedError("the geometry kernel needs javac")
    spark.sql(f"ADD JAR '{_jar(spark)}'")
    for name, (cls, kind) in FUNCTIONS.items():
        spark.udf.registerJavaFunction(name, f"Geo${cls}", kind)
    _registered.add(app)


def geo(name: str, *args: Column | str) -> Column:
    """A call of geo_<name>."""
    return F.call_function(f"geo_{name}", *[F.col(a) if isinstance(a, str) else a for a in args])


def with_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """df with xmin, ymin, xmax, ymax of a WKB column: computed once, never inside a join."""
    b = df.withColumn("_b", geo("bounds", geom))
    return b.select(*df.columns, *[F.col("_b")[i].alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))])


def frame_of(df: DataFrame, geom: str = "geom") -> tuple[tuple[float, float, float] | None, int]:
    """((least corner, size) of the square around all geometries, null without any; number of rows)."""
    b = F.col("_b")
    x0, y0, x1, y1, n = df.select(geo("bounds", geom).alias("_b")).agg(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3]), F.count(F.lit(1))).first()
    return None if x0 is None else (float(x0), float(y0), float(max(x1 - x0, y1 - y0))), n


def united(df: DataFrame, keys: list[str], frame: tuple[float, float, float], n: int, geom: str = "geom", fan: int = 64) -> DataFrame:
    """(keys, _part, geom): unions of up to fan of n pieces of a key that follow each other along a Hilbert curve."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.select(*keys, geom).withColumn("_at", geo("place", geom, *[F.lit(v) for v in frame]))
    placed = placed.repartitionByRange(max(1, min(most, n // (16 * fan))), *keys, "_at").sortWithinPartitions(*keys, "_at", geom)
    placed = placed.withColumn("_part", F.floor(F.monotonically_increasing_id() / fan))
    return placed.groupBy(*keys, "_part").agg(F.collect_set(geom).alias("_g")).select(*keys, "_part", geo("union_all", "_g").alias(geom))


def union_agg(df: DataFrame, keys: list[str], geom: str = "geom", fan: int = 64) -> DataFrame:
    """Union of the geometries of each key, in a tree of as many levels as the largest group needs.

    Each level unites up to fan different pieces that follow each other along a
    Hilbert curve, so inner edges vanish level by level: what goes up is the
    outline, and no task holds a whole large group. Small groups stay out of it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    df = df.select(*keys, geom)
    if largest > fan:
        small = None
        if keys:
            of = sizes.where(F.col("_n") > fan).withColumnsRenamed({k: f"_k_{k}" for k in keys})
            df = stored(df.join(of, [df[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").select(*keys, geom, "_n"))
            df, small = df.where("_n is not null").select(*keys, geom), df.where("_n is null").select(*keys, geom)
        else:
            df = stored(df)
        frame, n = frame_of(df, geom)
        while largest > fan and frame:
            df = stored(united(df, keys, frame, n, geom, fan).select(*keys, geom))
            before, n = largest, df.count()
            largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
            if largest >= before:
                break
        df = df if small is None else df.union(small)
    return df.groupBy(*keys).agg(F.collect_list(geom).alias("_g")).select(*keys, geo("union_all", "_g").alias(geom))
