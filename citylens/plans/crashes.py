"""Injury severity by area and month, yearly change, distinct crashes, taxi crashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.functions.dates import parse_coerce, parse_strict
from citylens.functions.rules import with_severity
from citylens.functions.text import text_to_int
from citylens.operators import geo
from citylens.operators.aggregates import distinct_grid, group_sum, with_subtotals
from citylens.operators.joins import salted_join
from citylens.operators.project import any_equal, keep_or
from citylens.operators.reshape import grid_fill
from citylens.operators.windows import change_percent
from citylens.plans.places import CBD_BOARDS, CRZ, REPORTED_AREAS
from citylens.session import stage

SEVERITIES = ["K", "A", "B", "C"]
ADJACENT = [a for a in REPORTED_AREAS if a != CRZ]
TOTALS = {
    "CRZ Adjacent Total": ADJACENT,
    "CRZ Total": [CRZ],
    "Other Total": ["Other"],
    "City Total": None,
}


def classify_persons(persons: DataFrame, crashes: DataFrame) -> DataFrame:
    """Persons with the location of their crash and a severity letter."""
    places = crashes.select("COLLISION_ID", "LATITUDE", "LONGITUDE")
    joined = persons.join(places, "COLLISION_ID", "inner")
    return with_severity(joined, "SEVERITY", "PERSON_INJURY", "EMOTIONAL_STATUS", "COMPLAINT", "BODILY_INJURY")


def locate(persons: DataFrame, index: geo.RegionIndex, groups: DataFrame) -> DataFrame:
    """Add ``area``: the group of neighbourhoods the crash lies in or on.

    Rows on the outline of several areas appear once per area, rows outside all keep NULL.
    """
    placed = geo.with_point(persons, "LONGITUDE", "LATITUDE")
    touching = geo.intersecting_regions(geo.distinct_points(placed, "x", "y"), index)
    return geo.label_points(placed, geo.dissolve(touching, groups), ("x", "y"), "area", "left")


def monthly_counts(rows: DataFrame, date: str = "CRASH_DATE", areas: list[str] = REPORTED_AREAS) -> DataFrame:
    """Zero-filled counts by year, month, severity and area, other areas merged.

    All months of every year seen appear for every severity.  Rows whose date cannot be read are left out.
    """
    when = parse_coerce(date)
    dated = rows.where(F.col("SEVERITY").isin(SEVERITIES)).select(
        F.year(when).alias("CRASH_YEAR"), F.month(when).alias("CRASH_MONTH"), "SEVERITY",
        keep_or(F.col("area"), areas, "Other").alias("grouped"), F.lit(1).alias("count"),
    )
    keys = ["CRASH_YEAR", "CRASH_MONTH", "SEVERITY"]
    counts = stage(group_sum(dated, [*keys, "grouped"], {"count": "count"}, keep_missing=False), "monthly_counts")
    return grid_fill(counts, counts, "CRASH_YEAR", {"CRASH_MONTH": list(range(1, 13)), "SEVERITY": SEVERITIES, "grouped": [*areas, "Other"]})


def summary(counts: DataFrame, adjacent: list[str] = ADJACENT, totals: dict[str, list[str] | None] = TOTALS) -> DataFrame:
    """Rows of the adjacent areas plus the named totals."""
    return with_subtotals(counts, ["CRASH_YEAR", "CRASH_MONTH", "SEVERITY"], "grouped", "count", totals, keep=adjacent)


def yearly_change(rows: DataFrame, totals: list[str] = list(TOTALS), months: tuple[int, int] = (1, 12)) -> DataFrame:
    """Yearly counts of the totals and their percent change on the year before."""
    chosen = rows.where(F.col("grouped").isin(totals) & F.col("CRASH_MONTH").between(*months))
    yearly = group_sum(chosen, ["CRASH_YEAR", "SEVERITY", "grouped"], {"count": "count"}, keep_missing=False)
    return change_percent(yearly, ["SEVERITY", "grouped"], "CRASH_YEAR", "count", 1)


def distinct_crashes(rows: DataFrame, years: DataFrame, date: str = "CRASH_DATE") -> DataFrame:
    """Crashes per year x severity, each crash once; ``years`` lists the rows in ``crash_year``.

    Covers dates whose text carries its year as ``M/d/yyyy``.
    """
    dated = rows.withColumn("crash_year", F.year(parse_coerce(date)))
    return distinct_grid(dated, "crash_year", "SEVERITY", "COLLISION_ID", years, SEVERITIES)


def taxi_injuries(crashes: DataFrame) -> DataFrame:
    """Crashes with a taxi in which someone was hurt."""
    vehicles = [f"VEHICLE_{i}" for i in range(1, 6)]
    hurt = (text_to_int("INJURED") > 0) | (text_to_int("KILLED") > 0)
    return crashes.where(any_equal(vehicles, "Taxi") & hurt)


def taxi_by_year(
    crashes: DataFrame, labels: DataFrame, zone: list[str] = CBD_BOARDS, date: str = "CRASH_DATE",
    xy: tuple[str, str] = ("x", "y"),
) -> DataFrame:
    """Injury crashes with a taxi per year, inside the zone and elsewhere.

    A crash without a board counts in neither part.  Filters run before the boards are attached.
    """
    chosen = taxi_injuries(crashes)
    year = F.year(parse_strict(date)).alias("crash_year")
    per_point = chosen.groupBy(year, *xy).agg(F.count(F.lit(1)).alias("_n"))
    boards = labels.groupBy("x", "y").agg(F.min("region").alias("board"))
    placed = salted_join(per_point, boards.select(F.col("x").alias(xy[0]), F.col("y").alias(xy[1]), "board"), list(xy), "left")
    inside = F.col("board").isin(zone)
    return placed.groupBy("crash_year").agg(
        F.sum("_n").alias("taxi_count"),
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("taxi_count_cbd"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("taxi_count_other"),
    )
