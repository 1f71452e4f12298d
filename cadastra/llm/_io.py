"""Shared-folder tables that cut lineage between the jobs of one operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadastra.shipping import ship
from cadastra.storage import shared_root

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Parquet tables of one operator call, in one folder of the shared root.

    Tables are read back from storage, so a lost executor costs a re-read and
    never a recomputation of the job before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/cadastra/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write df, read it back, and drop the shuffle files that the write used."""
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.option("compression", codec).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later job reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Ready this session's Python workers; bound its Arrow batches, as texts may be long.

    The bounds hold when a plan runs, which is after an operator has returned it,
    so they stay with the session; a smaller bound of the session's own is kept.
    """
    ship(spark)
    for key, most in ((_BATCH_ROWS, rows), (_BATCH_BYTES, 16 << 20)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
