"""Keyed ingest of the events table, delivered in overlapping pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylens.catalog.registry import query, table
from citylens.operators.ordering import stack
from citylens.session import scratch_path
from citylens.sources.schemas import FEEDS, Feed, schema
from citylens.streaming import ingest

FEED = Feed(schema("ts timestamp_ntz, user_id bigint, event_type string, event_id bigint, value double"), ("ts", "user_id", "event_type"), "ts")
FIRST_DAYS = "ts < timestamp_ntz'2024-01-11 00:00:00'"
OVERLAP = "ts >= timestamp_ntz'2024-01-10 23:00:00'"
ROWS_SQL = """(SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN event_type END AS event_type, user_id, value, ts FROM events)"""
ALL_SQL = f"SELECT event_id, event_type, value FROM {ROWS_SQL}"


def rows(spark, sf):
    """Events, some without a type: a missing key part."""
    kind = F.when(F.col("event_id") % 20 != 0, F.col("event_type"))
    return table(spark, sf, "events").withColumn("event_type", kind).drop("props")


def shown(spark, path):
    return ingest.read_target(spark, path, FEED).select("event_id", "event_type", "value")


@query("ingest_watermark", """SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-11')""")
def ingest_watermark(spark, sf):
    path = scratch_path(spark, "ingest_mark")
    ingest.insert_new(rows(spark, sf).where(FIRST_DAYS), path, FEED)
    mark = ingest.high_water(ingest.stored(spark, path, FEED), FEED)
    return ingest.since(rows(spark, sf), "ts", mark).select("event_id")


@query("ingest_insert_new", ALL_SQL)
def ingest_insert_new(spark, sf):
    path = scratch_path(spark, "ingest_batch")
    ingest.insert_new(rows(spark, sf).where(FIRST_DAYS), path, FEED)
    late = rows(spark, sf).where(OVERLAP)
    ingest.insert_new(late.unionByName(late), path, FEED)
    ingest.insert_new(late, path, FEED)
    return shown(spark, path)


@query("ingest_stream", ALL_SQL)
def ingest_stream(spark, sf):
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "ingest_stream")
    pages = rows(spark, sf).unionByName(rows(spark, sf).where(OVERLAP)).withColumn("extra", F.lit(1))
    pages.repartitionByRange(6, "ts").write.parquet(landing)
    landing_schema = schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, extra int")
    ingest.ingest_stream(spark, landing, path, scratch_path(spark, "checkpoint"), FEED, landing_schema, files_per_batch=3)
    return shown(spark, path)


@query("ingest_publish", """SELECT 'row_count' AS what, count(*) AS n FROM events
    UNION ALL (SELECT 'latest', event_id FROM events ORDER BY ts DESC LIMIT 3)""")
def ingest_publish(spark, sf):
    path = scratch_path(spark, "ingest_publish")
    ingest.ingest_landing(rows(spark, sf), path, FEED)
    count, last = ingest.publish(spark, path, FEED, path + "-published")
    frames = {"row_count": count.select(F.col("row_count").alias("n")), "latest": last.select(F.col("event_id").alias("n"))}
    return stack(frames, "what")


# Key parts of the declared feeds by type, from the events table; every feed gets pages that overlap by an hour.
PART_SQL = {"string": "event_type", "int": "user_id % 7", "double": "user_id % 5"}
PLACED = "minute(ts) % 2 = 0"


def _feed_page(rows, feed):
    """Rows as a feed delivers them: its key, and a point structure where it has one; other columns are left out."""
    parts = {"string": F.col("event_type"), "int": F.col("user_id") % 7, "double": (F.col("user_id") % 5).cast("double")}
    columns = [F.col("ts").cast("timestamp").alias(feed.time)]
    for field in feed.schema.fields:
        if field.name in feed.key and field.name != feed.time:
            columns.append(parts[field.dataType.simpleString()].cast(field.dataType).alias(field.name))
    if "georeference" in feed.schema.fieldNames():
        point = F.struct(F.lit("Point").alias("type"), F.array(F.hour("ts") / 8, F.minute("ts") / 8).alias("coordinates"))
        columns.append(F.when(F.expr(PLACED), point).alias("georeference"))
    return rows.select(*columns)


def _feed_sql(name, feed):
    kinds = {field.name: field.dataType.simpleString() for field in feed.schema.fields}
    parts = ", ".join(PART_SQL[kinds[k]] for k in feed.key if k != feed.time)
    points = f"count(*) FILTER ({PLACED})" if "georeference" in kinds else "0"
    return f"""SELECT '{name}' AS feed, count(*) AS n, {points} AS points, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest
        FROM (SELECT DISTINCT ts, {parts} FROM events)"""


@query("ingest_feeds", " UNION ALL ".join(_feed_sql(name, feed) for name, feed in FEEDS.items()))
def ingest_feeds(spark, sf):
    """The declared feeds, each in two pages that overlap."""
    events, shown = table(spark, sf, "events"), {}
    for name, feed in FEEDS.items():
        path = scratch_path(spark, name)
        for page in (events.where(FIRST_DAYS), events.where(OVERLAP)):
            ingest.insert_new(_feed_page(page, feed), path, feed)
        point = F.col("georeference").rlike("^POINT [(]") if "georeference" in feed.schema.fieldNames() else F.lit(False)
        shown[name] = ingest.read_target(spark, path, feed).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(point, F.lit(False))).alias("points"),
            F.date_format(F.max(feed.time), "yyyy-MM-dd HH:mm:ss").alias("newest"),
        )
    return stack(shown, "feed")
