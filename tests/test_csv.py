"""CSV tables: quotes, doubled quotes, line breaks in fields, byte-order marks, blank rows, missing files."""

import pytest

from cadastra.sources.layers import read_table


def test_rfc_4180(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿iso3,"country ""name""",note\r\nKEN,"Kenya, Republic","two\nlines"\r\n,,\r\nUGA,"say ""hi""",\r\n'.encode())
    df = read_table(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["iso3", 'country "name"', "note"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("KEN", "Kenya, Republic", "two\nlines"), ("UGA", 'say "hi"', None)]


def test_missing_file(spark, tmp_path):
    assert read_table(spark, f"file://{tmp_path}/none.csv", "iso3 string, n string").columns == ["iso3", "n"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, f"file://{tmp_path}/none.csv")


def test_geoparquet_footer(spark, tmp_path):
    import json
    import struct

    import pyarrow as pa
    import pyarrow.parquet as pq

    from cadastra.functions.geometry import geo, register_geometry
    from cadastra.sources.layers import geo_metadata, read_parquet_layer

    register_geometry(spark)
    point = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    table = pa.table({"other": pa.array([b"x"]), "shape_of_it": pa.array([point]), "fid": [7]})
    for name, meta in (("good", json.dumps({"primary_column": "shape_of_it"}).encode()), ("bad", b"{no json")):
        pq.write_table(table.replace_schema_metadata({"geo": meta}), f"{tmp_path}/{name}.parquet")
    assert geo_metadata(spark, f"file://{tmp_path}/good.parquet") == {"primary_column": "shape_of_it"}
    assert geo_metadata(spark, f"file://{tmp_path}/bad.parquet") is None
    row = read_parquet_layer(spark, f"file://{tmp_path}/good.parquet").select(geo("to_text", "geom").alias("text"), "fid", "fid_orig").first()
    assert (row.text, row.fid, row.fid_orig) == ("POINT (3 4)", 1, 7)
    spark.range(1).write.parquet(f"{tmp_path}/folder")
    assert geo_metadata(spark, f"file://{tmp_path}/folder") is None
