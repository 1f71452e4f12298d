"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cadastra.registry import ORACLES, QUERIES, Query

MODULES = ("spatial_queries", "name_queries", "table_queries", "topology_queries", "polygon_queries", "more_queries", "level_queries", "relation_queries", "workflow_queries")
for _name in MODULES:
    import_module(f"cadastra.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog between two versions of a layer."""
    return QUERIES["X08_changelog"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
