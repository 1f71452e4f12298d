"""A stream of unit tables is checked batch by batch, each file once."""

from cadastra.streaming.checks import UNITS, check_stream


def unit(code, name, parent="p"):
    return 2, "n", 0, "c", code, parent, name, 1


def test_each_file_is_checked_once(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    seen = []
    for k, rows in enumerate(([unit("a", " x "), unit("b", "N/A")], [unit(None, "lost"), unit("c", "fine name")])):
        spark.createDataFrame(rows, UNITS).coalesce(1).write.mode("append").parquet(source)
        query = check_stream(spark, source, target, f"file://{tmp_path}/mark", once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        seen.append({(r.kind, r.code_a) for r in spark.read.parquet(f"{target}/batch={k}").collect()})
    assert seen == [{("whitespace", "a"), ("placeholder-name", "b")}, {("blank-code", None)}]
