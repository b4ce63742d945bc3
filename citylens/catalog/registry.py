"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under ``key`` with the SQL that must give the same rows."""
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = build
        if sql:
            ORACLES[key] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
