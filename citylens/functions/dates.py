"""Parsing, time zones, calendar parts and day types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.functions.text import _c


def parse_strict(value: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Text to timestamp; bad text raises."""
    return F.to_timestamp(_c(value), fmt)


def parse_coerce(value: Column | str, fmt: str = "M/d/yyyy") -> Column:
    """Text to timestamp; bad text gives NULL."""
    return F.try_to_timestamp(_c(value), F.lit(fmt))


def utc_to_local(value: Column | str, zone: str = "America/New_York") -> Column:
    """Naive UTC timestamp to naive wall-clock time of ``zone``, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(value).cast("timestamp_ntz"))


def time_of_day(value: Column | str) -> Column:
    return F.date_format(_c(value), "HH:mm:ss")


def fractional_hour(value: Column | str) -> Column:
    """Hour of day with minutes and seconds as a fraction."""
    ts = _c(value)
    return F.hour(ts) + F.minute(ts) / F.lit(60) + F.second(ts) / F.lit(3600)


def fractional_hour_text(value: Column | str) -> Column:
    """The same from ``HH:mm:ss`` text."""
    part = F.split(_c(value), ":")
    return part[0].cast("int") + part[1].cast("int") / F.lit(60) + part[2].cast("int") / F.lit(3600)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from start to end with the fraction kept.

    Naive timestamps are subtracted as they are, whatever the session's time zone.
    """
    return (_c(end) - _c(start)).cast("interval second").cast("decimal(20,6)").cast("double")


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(_c(year), _c(month), F.lit(1))


def in_month_range(month: Column, start: int, end: int) -> Column:
    """Month number inside an inclusive range; start > end wraps over New Year."""
    if start <= end:
        return month.between(start, end)
    return (month >= start) | (month <= end)


def with_day_type(df: DataFrame, date: str, holidays: DataFrame, out: str = "day_type") -> DataFrame:
    """Add holiday / weekend / non-holiday weekday; ``holidays`` has one column ``holiday``.

    Holidays win over weekends.  The lookup is a left join on a table of distinct dates, so rows
    never multiply.
    """
    known = holidays.select(F.col("holiday").alias("_holiday")).distinct()
    kind = (
        F.when(F.col("_holiday").isNotNull(), "holiday")
        .when(F.weekday(F.col(date)) >= 5, "weekend")
        .otherwise("non-holiday weekday")
    )
    joined = df.join(known, F.to_date(F.col(date)) == F.col("_holiday"), "left")
    return joined.withColumn(out, kind).drop("_holiday")
