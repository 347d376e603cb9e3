"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import registry, sql_accounts, sql_analytics, sql_diffs, sql_entities, sql_planted, sql_records, sql_sources, sql_streams, sql_trees  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_analytics.overview(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
