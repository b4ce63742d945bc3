"""Exact deduplication with streaming keyed state.

Rows are keyed by the SHA-256 of their text with A-Z lower-cased.  A stream over the keys keeps, in
disk-backed (RocksDB) state that never expires, one entry per digest: the stable identifier of the row
that stays (the largest doc_id), the locator of its content and the number of rows.  Digests seen more
than once are hits: for them full bytes are compared, and texts that differ are set apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.llm.common import KEY_SLOTS, fold, map_batches, raw_bytes, slot_in_map, slot_map, without
from citylens.session import scratch_path, stage

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: no disk space is set aside for them, and memory is bounded for all of an executor together.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256_hex(folded: bytes) -> str:
    return hashlib.sha256(folded).hexdigest()


def sha256_column(text: Column) -> Column:
    """``sha256_hex`` of a text with A-Z lower-cased; null counts as empty."""
    return F.sha2(fold(F.coalesce(text.cast("string"), F.lit(""))), 256)


def digest_rows(docs: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """doc_id, digest, slot and locator (the file a row was read from, empty if it was made in memory).

    The SHA-256 is worked out where the rows are; another digest is asked from Python.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.input_file_name().alias("locator"))
    if digest is sha256_hex:
        named = read.select("doc_id", sha256_column(F.col("text")).alias("digest"), "locator")
    else:
        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "digest": [digest(text.lower()) for text in raw_bytes(batch, "text")], "locator": batch.column("locator")}

        named = map_batches(read, work, "doc_id long, digest string, locator string")
    return named.select("doc_id", "digest", F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(KEY_SLOTS)).alias("slot"), "locator")


def keyed_state(keys: DataFrame, folder: str) -> DataFrame:
    """Run the stream over the files of ``keys`` in ``folder``; returns digest, keep_id, locator, group_size, slot.

    A batch that is replayed overwrites its own folder.  Entries only grow, so the largest of the
    updates of several batches is the final one.
    """
    spark = keys.sparkSession
    out, checkpoint = scratch_path(spark, "dedup-updates"), scratch_path(spark, "dedup-stream")
    kept = F.max(F.struct("doc_id", "locator")).alias("kept")
    state = spark.readStream.schema(keys.schema).parquet(folder).groupBy("digest").agg(kept, F.count(F.lit(1)).alias("group_size"), F.first("slot").alias("slot"))

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        state.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.max("kept").alias("kept"), F.max("group_size").alias("group_size"), F.first("slot").alias("slot"))


def differing_hits(docs: DataFrame, groups: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    """Digests whose rows are not the same bytes: smallest and largest text of each hit are compared.

    The comparison is an aggregate with partial results in every task, so a group of any size sends at
    most two texts per task.
    """
    known = slot_map(groups.filter("group_size > 1"))

    def work(batch: pa.RecordBatch) -> dict | None:
        found = []
        for text in raw_bytes(batch, "text"):
            folded = text.lower()
            name = digest(folded)
            if slot_in_map(known.value, zlib.crc32(name.encode()) % KEY_SLOTS):
                found.append((name, folded))
        return {"digest": [d for d, _ in found], "body": [b for _, b in found]} if found else None

    bodies = map_batches(docs.select(F.col("text").cast("string")), work, "digest string, body binary")
    return bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).filter("low <> high").select("digest")


def exact_groups(docs: DataFrame, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept: one row per row of ``docs``.

    Null text counts as empty.  A null doc_id is smaller than any other.  Of rows that tie in text and
    doc_id exactly one is kept.  Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "dedup-keys")
    digest_rows(docs, digest).write.parquet(folder)
    keys = spark.read.schema("doc_id long, digest string, slot long, locator string").parquet(folder)
    groups = stage(keyed_state(keys, folder), "dedup-groups")
    differing = stage(differing_hits(docs, groups, digest), "dedup-differing")
    mapped = keys.select("doc_id", "digest")
    if not differing.isEmpty():
        # Texts that share a digest without being equal: the text itself becomes part of the key.
        exact = _with_text_key(docs, digest)
        apart = stage(exact.join(differing, "digest", "left_semi").select("doc_id", F.concat_ws(":", "digest", "body_key").alias("digest")), "dedup-apart")
        mapped = mapped.join(differing, "digest", "left_anti").unionByName(apart)
        more = apart.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = stage(groups.join(differing, "digest", "left_anti").select("digest", F.col("kept.doc_id").alias("keep_id"), "group_size").unionByName(more), "dedup-groups")
    else:
        groups = groups.select("digest", F.col("kept.doc_id").alias("keep_id"), "group_size")
    counted = stage(mapped.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows")), "dedup-rows")
    met = counted.join(groups, "digest")
    each = met.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == 1)).alias("kept"))


def _with_text_key(docs: DataFrame, digest: Callable[[bytes], str]) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        folded = [t.lower() for t in raw_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "digest": [digest(t) for t in folded], "body_key": [t.decode("utf-8", "replace") for t in folded]}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, digest string, body_key string")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    decided = exact_groups(docs).select("doc_id", F.col("digest").alias("key"), "kept")
    return without(docs, sha256_column(F.col("text")), decided)
