"""Name and code checks over an append stream of level-unit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadastra.operators import codes, names

UNITS = "level int, name_column string, name_index int, code_column string, code string, parent_code string, name string, row_count long"


def _write(target: str):
    def run(units: DataFrame, batch: int) -> None:
        """Findings of one batch, in a folder of its own: a batch that runs again replaces what it wrote."""
        units = units.persist()
        try:
            found = names.run_checks(units).select("kind", "level", F.col("name_column").alias("column_name"), "code_a", "name_a", "reason")
            found = found.unionByName(codes.check_codes(units).select("kind", "level", "column_name", "code_a", "name_a", "reason"))
            found.write.mode("overwrite").parquet(f"{target}/batch={batch}")
        finally:
            units.unpersist()

    return run


def check_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = UNITS, *, once: bool = False) -> StreamingQuery:
    """Check each batch of Parquet files that arrive at source; findings go to target/batch=<n>.

    Checks look at the units of one batch, so shares of a column and duplicates
    are those within it. With once the query stops after the files that are there.
    """
    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(_write(target)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
