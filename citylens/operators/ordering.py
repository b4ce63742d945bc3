"""Sorting, top rows, stacking and duplicate removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_nulls_last(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending on several keys with missing values at the end."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def latest(df: DataFrame, time: str, n: int, *tie_breakers: str) -> DataFrame:
    """The n most recent rows: a per-task top-n and a final merge, never a full sort."""
    return df.orderBy(F.col(time).desc_nulls_last(), *tie_breakers).limit(n)


def stack(frames: dict[object, DataFrame], tag: str | None = None) -> DataFrame:
    """Concatenate by column name, optionally tagging rows with their frame's key."""
    tagged = [df.withColumn(tag, F.lit(k)) if tag else df for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order``, then by the remaining columns.

    Missing key parts compare equal.  It is an aggregate (minimum of a row struct), so a key with
    very many copies is reduced in every task before the shuffle, and a retry picks the same row.
    """
    first = [c for c in (order or []) if c not in keys]
    rest = first + [c for c in df.columns if c not in keys and c not in first]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)
