"""Region files: JSON documents whose ``data`` rows hold a code and WKT text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODE_ITEM, WKT_ITEM = 9, 12  # fixed values: positions in a data row, counted from 1


def read_region_json(spark: SparkSession, path: str, one_document: bool = True, prefix: str = "cb_") -> DataFrame:
    """``(region, wkt)`` from region documents.

    ``one_document=True`` reads each file as one document (the published form); otherwise every
    line is a document, which lets Spark split large files.
    """
    documents = spark.read.schema("data array<array<string>>").option("multiLine", one_document).json(path)
    rows = documents.select(F.explode("data").alias("row"))
    code, wkt = F.try_element_at("row", F.lit(CODE_ITEM)), F.try_element_at("row", F.lit(WKT_ITEM))
    return rows.select(F.concat(F.lit(prefix), code).alias("region"), wkt.alias("wkt")).where(F.col("wkt").isNotNull())
