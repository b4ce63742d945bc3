"""Shared pieces: token rule, letter folding, training split and Arrow helpers."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citylens.llm.bitmaps import Bitmap
from citylens.session import stage

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: Column) -> Column:
    """Lower-case A-Z and leave every other character."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """Apply ``work`` to Arrow batches; it returns columns in schema order or None for no rows."""
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = work(batch) if batch.num_rows else None
            if found is not None:
                made = [found[f.name].cast(f.type) if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(made, schema=target)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def raw_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    column = batch.column(name)
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


# Slots of the fixed-size map of wanted keys: 4 MB however many keys there are.
KEY_SLOTS = 1 << 25


def slot(key: str) -> int:
    """Place of a key in the map; different keys may share one."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=4).digest(), "big") % KEY_SLOTS


def slot_map(keys: DataFrame):
    """Bitmap of the ``slot`` column as a broadcast of at most 4 MB, for ``in_map``."""
    bits = keys.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    return keys.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in bits.collect()})


def in_map(known: dict[int, bytes], key: str) -> bool:
    """False only if the key is not wanted."""
    return slot_in_map(known, slot(key))


def slot_in_map(known: dict[int, bytes], at: int) -> bool:
    """False only if no wanted key has this slot."""
    # Bucket 1 holds slots 1 to 32768; bit p of a byte string is bit p % 8 of byte p // 8.
    bits = known.get((at + 32767) // 32768 if at else 0)
    place = (at - 1) % 32768 if at else 0
    return bool(bits) and bool(bits[place // 8] >> place % 8 & 1)


# Bits of the map of rows to go: 4 MB however many they are.
LOST_BITS = 25


def without(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: ``decided`` has doc_id, key and kept for each row.

    Rows that tie in doc_id and key are interchangeable; as many of them stay as are kept.  Rows that a bitmap of
    those to go does not know stay where they are; only the others are joined.
    """
    names = {n: fresh_name(docs, n) for n in ("dedup_key", "dedup_row", "dedup_maybe")}
    lost = stage(decided.groupBy("doc_id", "key").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("rows")).filter("NOT any_kept OR rows > 1"), "dedup-lost")
    known = Bitmap(lost.select(F.xxhash64("doc_id", "key").alias("mark")), LOST_BITS)
    maybe = F.pandas_udf(lambda marks: pd.Series(known.contains(marks.to_numpy().view(np.uint64))), "boolean")
    keyed = docs.withColumn(names["dedup_key"], key)
    keyed = keyed.withColumn(names["dedup_maybe"], maybe(F.xxhash64(F.col("doc_id").cast("long"), names["dedup_key"])))
    sure = keyed.filter(~F.col(names["dedup_maybe"])).drop(names["dedup_maybe"])
    marked = keyed.filter(names["dedup_maybe"]).drop(names["dedup_maybe"])
    same = lambda other: marked["doc_id"].cast("long").eqNullSafe(other["doc_id"]) & (marked[names["dedup_key"]] == other["key"])
    out = sure.unionByName(marked.join(lost, same(lost), "left_anti"))
    tied = lost.filter("any_kept")
    if not tied.isEmpty():
        order = W.partitionBy("doc_id", names["dedup_key"]).orderBy("text")
        first = marked.join(tied, same(tied), "left_semi").withColumn(names["dedup_row"], F.row_number().over(order)).filter(F.col(names["dedup_row"]) == 1).drop(names["dedup_row"])
        out = out.unionByName(first)
    return out.drop(names["dedup_key"])
