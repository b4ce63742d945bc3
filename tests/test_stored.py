"""Stored stages, missing values and the spread of hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from citylens.functions.text import clean_text
from citylens.operators.joins import salted_join
from citylens.plans.trips import od_flow
from citylens.sinks import writers
from citylens.sources import tabular
from citylens.sources.schemas import FEEDS
from citylens.streaming import ingest

REGIONS = [("a", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), ("b", "POLYGON ((10 0, 14 0, 14 4, 10 4, 10 0))")]


def trips(spark, rows):
    return spark.createDataFrame(rows, "ox double, oy double, dx double, dy double")


def test_stored_labels_grow_with_new_points(spark, tmp_path):
    path = str(tmp_path / "labels")
    regions = spark.createDataFrame(REGIONS, "region string, wkt string")
    flow = lambda rows, **more: {(r.origin_region, r.destination_region): r.rides for r in od_flow(trips(spark, rows), regions, exclude=[], label_path=path, cell=1.0, **more).collect()}
    first, second = (1.0, 1.0, 2.0, 2.0), (1.5, 1.0, 11.0, 1.0)
    assert flow([first]) == {("a", "a"): 1}
    assert flow([first, second]) == {("a", "a"): 1, ("a", "b"): 1}
    # a known point in a new role, and a refresh
    assert flow([(11.0, 1.0, 1.0, 1.0)]) == {("b", "a"): 1}
    assert flow([first, second], refresh=True) == {("a", "a"): 1, ("a", "b"): 1}
    # other regions do not use these labels
    other = spark.createDataFrame([("c", REGIONS[0][1])], "region string, wkt string")
    assert {r.origin_region for r in od_flow(trips(spark, [first]), other, exclude=[], label_path=path, cell=1.0).collect()} == {"c"}


def test_half_written_stage_is_built_again(spark, tmp_path):
    path = str(tmp_path / "stage")
    spark.range(10).repartition(2).write.parquet(path)
    os.remove(next(os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("part-")))
    os.remove(f"{path}/_SUCCESS")
    assert writers.materialize_once(spark, path, lambda: spark.range(10)).count() == 10


def test_only_a_missing_target_counts_as_empty(spark, tmp_path):
    feed = next(iter(FEEDS.values()))
    assert ingest.stored(spark, str(tmp_path / "none"), feed).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        ingest.stored(spark, str(tmp_path / "bad"), feed).collect()


def test_missing_texts_are_null(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id,v,name\n1,1.0,x\n2,NaN,NA\n3,N/A,null\n4,,n/a\n5,2.5,Nan\n")
    rows = tabular.read_csv_missing(spark, str(path), "id int, v double, name string")
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [(1, 1.0, "x"), (2, None, None), (3, None, None), (4, None, None), (5, 2.5, "Nan")]
    assert rows.agg(F.avg("v")).first()[0] == 1.75
    path.write_text("id,v,name\n1,abc,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tabular.read_csv_missing(spark, str(path), "id int, v double, name string").collect()


def test_points_that_are_no_numbers_get_no_label(spark):
    regions = spark.createDataFrame(REGIONS, "region string, wkt string")
    rows = [(float("nan"), 1.0, 2.0, 2.0), (1.0, 1.0, 2.0, 2.0), (None, 1.0, 2.0, 2.0)]
    assert [tuple(r) for r in od_flow(trips(spark, rows), regions, exclude=[], cell=1.0).collect()] == [("a", "a", 1)]


def test_text_is_stripped_of_any_white_space(spark):
    assert spark.range(1).select(clean_text(F.lit("\t killed \r\n"))).first()[0] == "KILLED"


def test_equal_rows_of_a_hot_key_spread_over_salts(spark):
    big = spark.range(4000).repartition(16).select(F.lit(1).alias("k"))
    small = spark.createDataFrame([(1, "one")], "k int, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(big, small, ["k"], "left")
        assert joined.count() == 4000 and joined.filter("name = 'one'").count() == 4000
        salts = big.selectExpr("pmod(xxhash64(k, spark_partition_id()), 8) AS s").distinct().count()
        assert salts >= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
