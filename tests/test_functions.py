"""Scalar functions and rules on tiny frames."""

import datetime

import pytest
from pyspark.sql import functions as F

from citylens.functions import dates, rules, text
from citylens.operators import project
from citylens.plans.traffic import holiday_table


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("value,want", [
    ("12", 12), ("1.6", 2), ("0.4", 0), ("-1.5", -2), ("", None), ("n/a", None), (None, None), ("99999999999", None), ("1e3", 1000),
    ("1d", None), ("NaN", None), (" 7 ", 7), ("0.4999999", 0), ("2.5", 3),
])
def test_text_to_int(spark, value, want):
    assert one(spark, text.text_to_int(F.lit(value).cast("string"))) == want


def test_commas_and_thousands(spark):
    assert one(spark, text.cast_commas(F.lit("1,234.5"))) == 1234.5
    assert one(spark, text.try_int_commas(F.lit("12,345"))) == 12345
    assert one(spark, text.thousands(F.lit(1234567.9))) == "1,234,567"


def test_bad_number_raises_when_strict(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, text.cast_commas(F.lit("x")))


def test_split_pad_clean(spark):
    assert one(spark, text.split_index(F.lit("2024-05-06"), "-", 2)) == "05"
    assert one(spark, text.split_index(F.lit("a|b"), "|", 3)) is None
    assert one(spark, text.pad2(F.lit(7))) == "07" and one(spark, text.pad2(F.lit(113))) == "113"
    assert one(spark, text.clean_text(F.lit("  a b "))) == "A B"
    assert one(spark, text.clean_text(F.lit(None).cast("string"))) is None


def test_natural_order(spark):
    names = ["Queens Community Board 10", "Queens Community Board 9", "Central Park", "Staten Island Community Board 2", "Bronx Community Board 1"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(*text.natural_order("name")).collect()]
    # a two-word borough does not match the board pattern, so it sorts by its full name
    assert got == ["Bronx Community Board 1", "Central Park", "Queens Community Board 9", "Queens Community Board 10", "Staten Island Community Board 2"]


def test_parse(spark):
    assert one(spark, dates.parse_coerce(F.lit("2/30/2024"))) is None
    assert one(spark, F.to_date(dates.parse_coerce(F.lit("03/04/2024")))) == datetime.date(2024, 3, 4)
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        one(spark, dates.parse_strict(F.lit("soon")))


@pytest.mark.parametrize("utc,local", [
    ("2024-03-10 06:30:00", "2024-03-10 01:30:00"), ("2024-03-10 07:00:00", "2024-03-10 03:00:00"),
    ("2024-11-03 05:30:00", "2024-11-03 01:30:00"), ("2024-11-03 06:30:00", "2024-11-03 01:30:00"),
    ("2024-06-01 03:00:00", "2024-05-31 23:00:00"),
])
def test_daylight_saving(spark, utc, local):
    assert one(spark, dates.utc_to_local(F.lit(utc)).cast("string")) == local


def test_time_parts(spark):
    ts = F.lit("2024-01-02 03:30:36.5").cast("timestamp_ntz")
    assert one(spark, dates.fractional_hour(ts)) == pytest.approx(3.51)
    assert one(spark, dates.fractional_hour_text(F.lit("03:30:36"))) == pytest.approx(3.51)
    assert one(spark, dates.seconds_between(F.lit("2024-01-02 03:30:36").cast("timestamp_ntz"), ts)) == 0.5


def test_month_range_wraps(spark):
    months = [r.m for r in spark.range(1, 13).select(F.col("id").alias("m")).where(dates.in_month_range(F.col("m"), 11, 2)).collect()]
    assert months == [1, 2, 11, 12]


def test_day_types(spark, rows):
    days = ["2024-07-04", "2024-07-05", "2024-07-06", "2026-07-04"]
    df = spark.createDataFrame([(datetime.date.fromisoformat(d),) for d in days], "date date")
    got = dict(rows(dates.with_day_type(df, "date", holiday_table(spark)), "date", "day_type"))
    assert [got[datetime.date.fromisoformat(d)] for d in days] == ["holiday", "non-holiday weekday", "weekend", "weekend"]


SEVERITY_CASES = [
    ("Killed", None, None, None, "K"),
    ("injured ", "Unconscious", None, None, "A"),
    ("Injured", "Shock", " crush injuries", None, "A"),
    ("Injured", "Conscious", "Minor Bleeding", "Eye", "B"),
    ("Injured", "Conscious", "Minor Burn", "Head", "B"),
    ("Injured", "Conscious", "Complaint of Pain", "Head", "B"),
    ("Injured", "Conscious", "Complaint of Pain or Nausea", "Eye", "B"),
    ("Injured", "Does Not Apply", "Abrasion", None, "B"),
    ("Injured", "Conscious", "None Visible", "Unknown", "U"),
    ("Injured", "Conscious", "None Visible", "Head", "C"),
    ("Injured", "Conscious", "Whiplash", "Unknown", "C"),
    ("Injured", "Shock", "Unknown", "Does Not Apply", "C"),
    ("Injured", None, "Internal", None, "U"),
    ("Injured", "Conscious", None, None, "U"),
    ("Unspecified", "Unconscious", "Internal", None, "U"),
    (None, None, None, None, "U"),
]


def test_severity(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(SEVERITY_CASES)], "i int, a string, b string, c string, d string, want string")
    bad = df.where(rules.severity("a", "b", "c", "d") != F.col("want")).collect()
    assert bad == []


def test_column_choices(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "Taxi"), (None, "Bus")], "v string, w string")
    assert rows(df.select(project.keep_or(F.col("v"), ["a"], "Other").alias("o")), "o") == [("Other",), ("Other",), ("a",)]
    assert df.where(project.any_equal(["v", "w"], "Taxi")).count() == 1
    assert df.where(~project.any_equal(["v", "w"], "Taxi")).count() == 2
    assert project.replace_last(df, "v", F.upper("v")).columns == ["w", "v"]
