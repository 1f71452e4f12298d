"""Shared-folder tables that cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or on one machine (tests) a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cadastra-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: a lost executor costs a re-read.

    Joins of it are shuffled: files of ids and boxes are many times smaller than
    their rows, and a broadcast planned by their size would fill the driver.
    """
    path = f"{shared_root(df.sparkSession)}/cadastra/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
