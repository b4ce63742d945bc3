"""Readers, writers, markup and ingest."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from citylens.plans import traffic
from citylens.session import parameter_table, scratch_path
from citylens.sinks import writers
from citylens.sources import markup, regions, tabular
from citylens.sources.schemas import FEEDS, Feed, schema
from citylens.streaming import ingest

FEED = Feed(schema("ts timestamp, kind string, n int"), ("ts", "kind"), "ts")


def stamp(hour, minute=0):
    return datetime.datetime(2024, 5, 1, hour, minute)


def test_csv_readers(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "jan.csv").write_text("id,n,note\n007,1,\n008,2,x\n")
    path = str(tmp_path / "2024" / "jan.csv")
    assert tabular.read_csv_typed(spark, path).schema["id"].dataType.simpleString() == "int"
    assert [r.id for r in tabular.read_csv_override(spark, path, ["id"]).collect()] == ["007", "008"]
    text = tabular.read_csv_text(spark, path)
    assert {f.dataType.simpleString() for f in text.schema.fields} == {"string"} and text.first().note is None
    yearly = tabular.read_yearly_csv(spark, [str(tmp_path / "*" / "*.csv")], schema("id string, n int, note string"))
    assert {r.file_year for r in yearly.collect()} == {2024}
    bare = tabular.read_csv_headerless(spark, path, ["a", "b", "c"])
    assert bare.columns == ["a", "b", "c"] and bare.count() == 3


def test_region_json(spark, tmp_path):
    row = [None] * 8 + ["101", None, None, "POLYGON ((0 0, 1 0, 1 1, 0 0))"]
    path = tmp_path / "regions.json"
    path.write_text(json.dumps({"meta": {"x": 1}, "data": [row, row[:8] + ["102", None, None, None]]}, indent=1))
    assert [tuple(r) for r in regions.read_region_json(spark, str(path)).collect()] == [("cb_101", "POLYGON ((0 0, 1 0, 1 1, 0 0))")]


def test_largest_table(spark, tmp_path):
    page = """<table><tr><td>a</td></tr></table><TABLE id=x><tr><th>h</th><th>k</th></tr>
    <tr><td> <b>1</b>&amp;2 </td><td></td></tr></TABLE>"""
    (tmp_path / "p.html").write_text(page)
    (tmp_path / "q.html").write_text("<p>no table</p>")
    pages = markup.read_html_files(spark, str(tmp_path / "*.html"))
    got = markup.table_rows(pages).select("pos", "cells").orderBy("pos").collect()
    assert [(r.pos, r.cells) for r in got] == [(0, ["h", "k"]), (1, ["1&2", None])]


def test_count_page(spark):
    head = "<tr><th>All</th><th>All</th><th>All</th></tr><tr><th></th><th>Mon</th><th></th></tr><tr><th>Hour</th><th>2024-03-04</th><th>Workday</th></tr>"
    body = "".join(f"<tr><td>{h}</td><td>{v}</td><td>9</td></tr>" for h, v in [("00:00:00", "5"), ("01:00:00", ""), ("Total", "5")])
    body += "".join("<tr><td>x</td><td>1</td><td>1</td></tr>" for _ in range(35)) + "<tr><td>00:00:00</td><td>8</td><td>1</td></tr>"
    pages = spark.createDataFrame([(1, f"<table>{head}{body}</table>")], "id int, html string")
    got = sorted((r.direction, r.hour, r["count"]) for r in traffic.counts_from_pages(pages).collect())
    assert got == [("All", "00:00:00", 5.0), ("All", "01:00:00", None), ("Northbound", "00:00:00", 8.0)]


def test_materialize_once(spark):
    path = scratch_path(spark, "once")
    made = []

    def build(n):
        made.append(n)
        return spark.range(n)

    assert writers.materialize_once(spark, path, lambda: build(3)).count() == 3
    assert writers.materialize_once(spark, path, lambda: build(5)).count() == 3
    assert writers.materialize_once(spark, path, lambda: build(5), refresh=True).count() == 5
    assert made == [3, 5]


def test_tables_and_reports(spark):
    first = writers.create_table(spark.range(2), "once_table")
    again = writers.create_table(spark.range(9), "once_table")
    assert first.count() == again.count() == 2
    assert writers.create_table(spark.range(9), "once_table", replace=True).count() == 9
    paths = writers.write_report({"daily": spark.range(4)}, scratch_path(spark, "report"))
    assert spark.read.parquet(paths["daily"]).count() == 4


def test_parameter_table_quotes(spark):
    got = parameter_table(spark, "name string, n int", [("Hell's \\ Kitchen", 1), (None, None)]).collect()
    assert [tuple(r) for r in got] == [("Hell's \\ Kitchen", 1), (None, None)]


def pages(spark):
    data = [
        (stamp(1), "a", 1), (stamp(1), "a", 2), (stamp(1), None, 3), (stamp(2), "b", 4),
        (stamp(2), "b", 4), (stamp(2), None, 5), (stamp(3), "c", 6), (None, "d", 7),
    ]
    return spark.createDataFrame(data, FEED.schema).withColumn("extra", F.lit("x"))


def state(spark, path):
    return sorted(str(tuple(r)) for r in ingest.read_target(spark, path, FEED).collect())


def test_ingest_twice_changes_nothing(spark):
    path = scratch_path(spark, "target")
    ingest.insert_new(pages(spark), path, FEED)
    once = state(spark, path)
    assert len(once) == 6
    ingest.insert_new(pages(spark), path, FEED)
    assert state(spark, path) == once


def test_ingest_from_high_water(spark):
    path = scratch_path(spark, "target")
    assert ingest.high_water(ingest.stored(spark, path, FEED), FEED) == ingest.BEGINNING
    ingest.insert_new(pages(spark).where(F.col("ts") <= F.lit(stamp(2))), path, FEED)
    mark = ingest.high_water(ingest.stored(spark, path, FEED), FEED)
    assert mark == "2024-05-01 02:00:00"
    assert ingest.since(pages(spark), "ts", mark).count() == 4
    ingest.ingest_landing(pages(spark), path, FEED)
    assert len(state(spark, path)) == 5


def test_stream_equals_batch_and_replays_safely(spark):
    landing, batch, stream = (scratch_path(spark, n) for n in ("landing", "batch", "stream"))
    pages(spark).repartition(4).write.parquet(landing)
    ingest.insert_new(spark.read.parquet(landing), batch, FEED)
    raw = schema("ts timestamp, kind string, n int, extra string")
    ingest.ingest_stream(spark, landing, stream, scratch_path(spark, "cp"), FEED, raw, files_per_batch=1)
    keys = lambda p: sorted(str((r.ts, r.kind)) for r in ingest.read_target(spark, p, FEED).collect())
    assert keys(batch) == keys(stream)
    # a lost checkpoint reads every page again
    ingest.ingest_stream(spark, landing, stream, scratch_path(spark, "cp"), FEED, raw, files_per_batch=2)
    assert keys(batch) == keys(stream)


def test_publish(spark):
    path = scratch_path(spark, "target")
    ingest.insert_new(pages(spark), path, FEED)
    count, last = ingest.publish(spark, path, FEED, path + "-out", 2)
    assert count.first().row_count == 6 and last.first().ts == stamp(3) and last.count() == 2
    assert spark.read.parquet(path + "-out").count() == 6


@pytest.mark.parametrize("name", sorted(FEEDS))
def test_feeds_are_consistent(name):
    feed = FEEDS[name]
    assert feed.time in feed.key and set(feed.key) <= set(feed.schema.fieldNames())
