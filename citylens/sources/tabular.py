"""CSV and Parquet readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv_typed(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; types from ``schema``, or inferred, which costs one more pass over the text."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(_paths(paths))


def read_csv_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with header, every column as text; an empty field is NULL."""
    return spark.read.option("header", True).csv(_paths(paths))


# Texts that the usual data-frame readers take for missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def missing_to_null(df: DataFrame, tokens: Sequence[str] = MISSING) -> DataFrame:
    """NULL for missing-value texts in text columns and for NaN in number columns."""
    def clean(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return F.when(~value.isin(list(tokens)), value).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value), value).alias(field.name)
        return value

    return df.select(*[clean(f) for f in df.schema.fields])


def read_csv_missing(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, tokens: Sequence[str] = MISSING
) -> DataFrame:
    """CSV with header in a given schema, where missing-value texts are NULL in every column.

    Anything else that does not fit its type raises.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = missing_to_null(read_csv_text(spark, paths), tokens)
    typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted.fields])
    return missing_to_null(typed, tokens)


def read_csv_override(
    spark: SparkSession, paths: str | Sequence[str], text_columns: Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Keep the named columns as text, so ids keep leading zeros and commas.

    The other types come from ``schema``; without one they are inferred, which reads the text twice.
    """
    inferred = schema if schema is not None else read_csv_typed(spark, paths).schema
    forced = T.StructType([
        T.StructField(f.name, T.StringType() if f.name in set(text_columns) else f.dataType) for f in inferred.fields
    ])
    return read_csv_typed(spark, paths, forced)


def read_csv_headerless(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV without header; columns are named by position."""
    reader = spark.read.option("header", False)
    if schema is not None:
        return reader.schema(schema).csv(_paths(paths)).toDF(*names)
    return reader.csv(_paths(paths)).toDF(*names)


def read_yearly_csv(spark: SparkSession, globs: Sequence[str], schema: T.StructType) -> DataFrame:
    """Per-month files in year folders, with the folder's year and the file as columns.

    The folder, not the timestamp, says which year a row belongs to.
    """
    rows = spark.read.option("header", True).schema(schema).csv(list(globs))
    path = F.col("_metadata.file_path")
    return rows.select(*schema.fieldNames(), folder_year(path).alias("file_year"), path.alias("file_path"))


def folder_year(path: Column) -> Column:
    """The year folder directly above a file: ``2024`` or ``name=2024``."""
    return F.regexp_extract(path, r"/(?:[^/=]+=)?(\d{4})/[^/]+$", 1).try_cast("int")


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def _paths(paths: str | Sequence[str]) -> str | list[str]:
    return paths if isinstance(paths, str) else list(paths)
