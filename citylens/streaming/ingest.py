"""Insert-if-new ingest of keyed feeds.

A target is a Parquet folder that only grows, with one subfolder per day of the feed's time column and a Bloom
filter of each day's keys beside them.  Finding the newest time reads one day.  Rows whose key is in no filter are new
without a look at the target; for the others only the days with possible hits are read.
Loading the same rows twice changes nothing, so a task, a micro-batch or a whole run can be repeated
after a failure.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.operators.geo import geojson_point_wkt
from citylens.operators.joins import salted_join
from citylens.operators.ordering import first_per_key, latest
from citylens.operators.project import align_to_schema
from citylens.session import stage, stage_measured
from citylens.sinks.writers import finished_parts, remove_folder, write_parquet
from citylens.sources.schemas import Feed

DAY = "feed_day"
BEGINNING = "1900-01-01 00:00:00"  # fixed value: before any feed starts
KEY_FILTERS = "_key_filters"  # folder beside the days; readers of the target skip it
FILTER_BLOCKS, FILTER_HASHES = 64, 4  # blocks of 32768 bits that a day's filter has at most, and bits a key sets in its block
FILTER_PARTS = 32  # parts from which the filters are written anew as one
NO_DAY = "DATE'1000-01-01'"  # stands for a missing day


def with_point_text(rows: DataFrame, column: str = "georeference") -> DataFrame:
    """Rows as the feed declares them: a delivered point structure becomes ``POINT (x y)`` text; other rows stay as they are."""
    kind = dict(rows.dtypes).get(column, "")
    return rows.withColumn(column, geojson_point_wkt(column)) if kind.startswith("struct") else rows


def stored(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """The target with its day column, empty when nothing was written yet."""
    schema = T.StructType([*feed.schema.fields, T.StructField(DAY, T.DateType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_target(spark: SparkSession, path: str, feed: Feed) -> DataFrame:
    """The target's rows in feed columns."""
    return stored(spark, path, feed).drop(DAY)


def high_water(target: DataFrame, feed: Feed) -> str:
    """Newest time in the stored target as text; only single values reach the driver."""
    newest = target.agg(F.max(DAY)).first()[0]  # a partition column: no data pages are read
    if newest is None:
        return BEGINNING
    return target.where(F.col(DAY) == F.lit(newest)).agg(F.max(feed.time).cast("string")).first()[0]


def since(rows: DataFrame, time: str, mark: str) -> DataFrame:
    """Rows at or after the mark.  Boundary rows come again and are stopped by the key."""
    return rows.where(_at_or_after(rows, time, mark))


def _at_or_after(rows: DataFrame, time: str, mark: str) -> Column:
    # the literal takes the column's type, so the comparison can be pushed into the scan
    return F.col(time) >= F.lit(mark).cast(rows.schema[time].dataType)


def _filter_parts(spark: SparkSession, path: str) -> list[str]:
    """Finished parts of the filters of a target."""
    return finished_parts(spark, f"{path}/{KEY_FILTERS}")


def _filters(spark: SparkSession, parts: list[str]) -> DataFrame:
    """Filters ``(day, block, bits)`` of the given parts, one row per block."""
    rows = spark.read.schema("day date, block long, bits binary").parquet(*parts)
    return rows.groupBy("day", "block").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def _in_filter(rows: DataFrame, feed: Feed) -> DataFrame:
    """Rows with the place of their key in the filter of its day: ``_day``, ``_block`` and the bits ``_at``."""
    # a missing part of a key is told from an empty one
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in feed.key]
    place = lambda n, most: F.pmod(F.xxhash64(F.lit(n), *parts), F.lit(most))
    return rows.withColumns({
        "_day": F.coalesce(F.to_date(feed.time) if feed.time in feed.key else F.lit(None).cast("date"), F.expr(NO_DAY)), "_block": place(0, FILTER_BLOCKS),
        "_at": F.array(*[place(n + 1, 32768) for n in range(FILTER_HASHES)]),
    })


def remember_keys(rows: DataFrame, path: str, feed: Feed) -> None:
    """Add the keys of rows to the filters of their days, as a part that counts once it is finished.

    Keys are remembered before their rows are written: a filter may know a key that the target has not, never the
    other way round.  Many small parts become one.
    """
    spark, folder = rows.sparkSession, f"{path}/{KEY_FILTERS}"
    places = _in_filter(rows, feed).select("_day", "_block", F.explode("_at").alias("at"))
    made = places.groupBy(F.col("_day").alias("day"), F.col("_block").alias("block")).agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    write_parquet(made, f"{folder}/part-{uuid.uuid4().hex}")
    parts = _filter_parts(spark, path)
    if len(parts) > FILTER_PARTS:
        write_parquet(_filters(spark, parts), f"{folder}/part-{uuid.uuid4().hex}")
        for part in parts:
            remove_folder(spark, part)


def _listed(day: Column) -> Column:
    return F.array_join(F.collect_set(day.cast("string")), ",")


def _dates(text: str) -> list[datetime.date]:
    return [datetime.date.fromisoformat(day) for day in text.split(",") if day]


def new_rows(batch: DataFrame, target: DataFrame, feed: Feed, path: str) -> DataFrame:
    """Rows of the batch whose key is not in the stored target, one per key, as a table of their own.

    The batch is read once.  Rows that no filter knows are new; for the others the days with possible hits are
    read, and of these the key columns.  Missing key parts compare equal.  Days are dates of the calendar, so lists of them are short.
    """
    spark, columns, keys = batch.sparkSession, feed.schema.fieldNames(), list(feed.key)
    parts = _filter_parts(spark, path)
    if not parts and not target.isEmpty():
        remember_keys(target, path, feed)  # a target from before there were filters
        parts = _filter_parts(spark, path)
    aligned = align_to_schema(with_point_text(batch), feed.schema)
    # columns that the batch lacks are missing in every row and choose none; with keys alone, rows are hashed and not sorted
    told = [c for c in columns if c in keys or c in batch.columns]
    single = _in_filter(align_to_schema(first_per_key(aligned.select(*told), keys), feed.schema), feed)
    if not parts:
        return stage(single.select(*columns), "page")
    single, found = stage_measured(single, "page", days=_listed(F.col("_day")))
    filters = _filters(spark, parts).where(F.col("day").isin(_dates(found["days"]))).selectExpr("day AS _day", "block AS _block", "bits")
    # bit p of a filter block is bit p % 8 of byte p // 8
    held = "forall(_at, p -> shiftright(CAST(conv(hex(substring(bits, CAST(p DIV 8 AS INT) + 1, 1)), 16, 10) AS INT), CAST(p % 8 AS INT)) & 1 = 1)"
    met = single.join(filters, ["_day", "_block"], "left").withColumn("_maybe", F.expr(f"coalesce({held}, false)")).drop("bits")
    page, found = stage_measured(met, "page", days=_listed(F.when(F.col("_maybe"), F.col("_day"))))
    fresh, days = page.where("NOT _maybe").select(*columns), _dates(found["days"])
    if not days:
        return fresh
    if feed.time in keys:  # else a known key may lie in any day
        inside = [day for day in days if day.year > 1000]
        hit = F.col(DAY).isin(inside) if inside else F.lit(False)
        target = target.where(hit if len(inside) == len(days) else hit | F.col(DAY).isNull())
    unknown = salted_join(page.where("_maybe").select(*columns), target.select(*keys).distinct(), keys, "left_anti", null_safe=True)
    return stage(fresh.unionByName(unknown), "new_rows")


def insert_new(batch: DataFrame, path: str, feed: Feed) -> None:
    """Append the new rows of a batch to the target."""
    spark = batch.sparkSession
    rows = new_rows(batch, stored(spark, path, feed), feed, path).withColumn(DAY, F.to_date(feed.time))
    if rows.isEmpty():
        return
    remember_keys(rows, path, feed)
    # few files per day, and a day with very many rows is split over tasks
    rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def ingest_landing(landing: DataFrame, path: str, feed: Feed) -> None:
    """One batch run: landing rows from the target's newest time on, inserted if new."""
    mark = high_water(stored(landing.sparkSession, path, feed), feed)
    insert_new(since(landing, feed.time, mark), path, feed)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    path: str,
    checkpoint: str,
    feed: Feed,
    landing_schema: T.StructType | None = None,
    source: str = "parquet",
    files_per_batch: int = 100,
) -> None:
    """Drain the landing folder page by page and stop.

    The checkpoint remembers which files were read; a repeated micro-batch adds nothing because
    ``insert_new`` looks at the target first.
    """
    pages = (
        spark.readStream.schema(landing_schema or feed.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(source)
        .load(landing)
    )

    def load(batch: DataFrame, _: int) -> None:
        insert_new(batch, path, feed)

    query = (
        pages.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def changed_days(target: DataFrame, published: DataFrame) -> DataFrame:
    """Days whose number of rows differs from what readers have.  A target only grows, so no other day has changed."""
    rows = lambda df, n: df.groupBy(DAY).agg(F.count(F.lit(1)).alias(n))
    have, show = rows(target, "have").alias("h"), rows(published, "show").alias("s")
    both = have.join(show, F.col(f"h.{DAY}").eqNullSafe(F.col(f"s.{DAY}")), "left")
    return both.where("show IS NULL OR have <> show").select(F.col(f"h.{DAY}").alias(DAY))


def publish(spark: SparkSession, path: str, feed: Feed, out: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Write the target for readers; return its row count and latest rows as DataFrames.

    Readers get a folder with one subfolder per day.  Only days that have changed since the last run are written, each as a
    whole, so a run that is repeated or broken off leaves no day half published.
    """
    target = stored(spark, path, feed)
    # dates of the calendar: a short list, with which other days are never opened
    days = [r[0] for r in changed_days(target, stored(spark, out, feed)).collect()]
    if days:
        known = [day for day in days if day is not None]
        chosen = F.col(DAY).isin(known) if known else F.lit(False)
        rows = target.where(chosen if None not in days else chosen | F.col(DAY).isNull())
        rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(out)
    count = target.agg(F.count(F.lit(1)).alias("row_count"))
    return count, latest(read_target(spark, path, feed), feed.time, n, *[k for k in feed.key if k != feed.time])
