"""Column work: choose, align, derive, flag, blank out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.operators.joins import salted_join


def replace_last(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Recompute a column from its old value and move it to the end."""
    kept = [c for c in df.columns if c != column]
    return df.select(*[F.col(f"`{c}`") for c in kept], value.alias(column))


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, cast by name; missing ones NULL, extra ones dropped."""
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        source = F.col(f"`{field.name}`") if field.name in have else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name contains a match of the regular expression."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def keep_or(column: Column, values: list, other: object) -> Column:
    """The value where it is listed, ``other`` where it is not (missing included)."""
    return F.when(column.isin(values), column).otherwise(F.lit(other))


def blank_unless(df: DataFrame, column: str, valid: DataFrame, on: list[str]) -> DataFrame:
    """Set ``column`` to NULL on rows whose key is not in ``valid``; every row is kept."""
    marks = valid.select(*on).distinct().withColumn("_valid", F.lit(True))
    joined = salted_join(df, marks, on, "left")
    return joined.withColumn(column, F.when(F.col("_valid"), F.col(column))).drop("_valid")


def any_equal(columns: list[str], value: object) -> Column:
    """True when any of the columns equals the value; missing cells never decide."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").eqNullSafe(F.lit(value)) for c in columns])
