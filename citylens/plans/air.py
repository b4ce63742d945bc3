"""Fine-particle means with a data-completeness gate, for hourly and daily feeds."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.functions.dates import fractional_hour_text, in_month_range, time_of_day, utc_to_local
from citylens.operators.aggregates import group_mean, mean_of_means
from citylens.operators.reshape import grid_fill, in_given_order, month_columns, pivot_mean
from citylens.operators.windows import gate, gated_mean
from citylens.session import stage

VALID_SHARE = 0.6  # fixed value: least share of readings in a 30-day month
HOURLY_CUTOFF, HOURS_PER_MONTH = VALID_SHARE * 24 * 30, 24 * 31
DAILY_CUTOFF, DAYS_PER_MONTH = VALID_SHARE * 30, 31

# Hourly sites, code and name.
HOURLY_SITES = [
    ("36005NY11534", "mott_haven"), ("36005NY11790", "hunts_point_upper"), ("36005NY12387", "cross_bronx_expwy"),
    ("36047NY07974", "bq_expwy"), ("36061NY08454", "manhattan_bridge"), ("36061NY08552", "williamsburg_bridge"),
    ("36061NY08653", "fdr"), ("36061NY09734", "broadway_and_35th"), ("36061NY09929", "midtown_west"),
    ("36061NY10130", "queensboro_bridge"), ("36061NY12380", "wheights_hamilton_bridge"), ("36081NY07615", "van_wyck"),
    ("36081NY08198", "glendale"), ("36081NY09285", "queens_college_lie"), ("36085NY03820", "si_expwy"),
    ("36085NY04805", "port_richmond"), ("360470118", "bushwick"), ("360850111", "freshkills"),
    ("360470052", "sunset_park_bqe"), ("360050112", "hunts_point_lower"), ("360810120", "maspeth_lie"),
    ("360810124", "queens_college_2_lie"), ("360050080", "highbridge-mteden"), ("360050110", "longwood"),
    ("360610135", "ccny"), ("360610115", "wheights_washington_bridge"),
]
# Row order of the hourly report.
HOURLY_ORDER = [
    "bushwick", "maspeth_lie", "freshkills", "sunset_park_bqe", "queens_college_2_lie", "ccny", "longwood",
    "hunts_point_lower", "wheights_washington_bridge", "highbridge-mteden", "mott_haven", "hunts_point_upper",
    "cross_bronx_expwy", "bq_expwy", "manhattan_bridge", "williamsburg_bridge", "fdr", "broadway_and_35th",
    "midtown_west", "queensboro_bridge", "wheights_hamilton_bridge", "van_wyck", "glendale", "queens_college_lie",
    "si_expwy", "port_richmond",
]
# Row order of the daily report.
DAILY_ORDER = [
    "IS 45", "Rahway", "Rockland County", "Elizabeth Lab", "Queens College Near Road", "BABYLON", "NEWBURGH", "Chester",
    "Paterson", "Jersey City Firehouse", "WHITE PLAINS", "RICHMOND POST OFFICE", "EISENHOWER PARK", "Rutgers University",
    "Toms River", "Flemington", "Fort Lee Near Road", "PS 19", "PFIZER LAB SITE", "HOLTSVILLE",
    "Union City High School", "JHS 126",
]
# Accepted daily methods and the source accepted with any method.
DAILY_METHODS = ["Met One BAM-1022 Mass Monitor w/ VSCC or TE-PM2.5C", "PM2.5 SCC w/Correction Factor"]
DAILY_SOURCE = "AirNow"
# End of fixed values.


def localize(hourly: DataFrame, time: str = "ObservationTimeUTC", zone: str = "America/New_York") -> DataFrame:
    """Add local date, time of day and month to hourly readings."""
    local = utc_to_local(time, zone)
    return hourly.withColumns({"local_date": F.to_date(local), "local_time": time_of_day(local), "month": F.month(local)})


def file_completeness(
    hourly: DataFrame, site: str, time: str, file: str, sites: list[str],
    cutoff: float = HOURLY_CUTOFF, per_month: int = HOURS_PER_MONTH,
) -> DataFrame:
    """Rows per file and listed site; the month is the UTC month in which the file starts.

    Readings are counted per file and site first; months are then found on those few rows.
    """
    partial = hourly.groupBy(file, site).agg(
        F.count(F.lit(1)).alias("valid_count"), F.min(time).alias("_first")
    )
    partial = stage(partial, "file_counts")
    months = partial.groupBy(file).agg(F.substring(F.min("_first").cast("string"), 1, 7).alias("year_month"))
    grid = grid_fill(partial, partial, file, {site: sites}, "valid_count")
    return gate(grid.join(months, file), cutoff, per_month)


def valid_months(gates: DataFrame, site: str, month_text: str, separator: str = "-", part: int = 2) -> DataFrame:
    """``(site, year, month)`` of valid periods out of ``yyyy-MM`` (or ``M/yyyy``) text."""
    pieces = F.split(F.col(month_text), separator)
    month = F.try_element_at(pieces, F.lit(part)).cast("int")
    year = F.try_element_at(pieces, F.lit(3 - part)).cast("int")
    return gates.where("valid").select(site, year.alias("year"), month.alias("month")).distinct()


def monthly_by_site(
    readings: DataFrame, gates: DataFrame, site: str, year: str, value: str, drop: bool = False
) -> DataFrame:
    """Monthly mean per site; months failing the gate are NULL, or dropped.

    ``gates`` has ``(site, year, month)`` of valid months; ``readings`` carries the same names.
    """
    means = group_mean(readings, [site, year, "month"], value)
    return gated_mean(means, gates.withColumn("valid", F.lit(True)), [site, year, "month"], value, drop)


def daily_by_month(
    daily: DataFrame, site: str, date: str, value: str, sites: list[str],
    cutoff: float = DAILY_CUTOFF, per_month: int = DAYS_PER_MONTH,
) -> DataFrame:
    """Counts, gate and gated mean per site, year and month of a daily feed in one pass.

    All twelve months of every year seen appear for every listed site.  ``mean`` is NULL unless the
    month passes the gate.
    """
    when = F.to_date(F.col(date))
    grouped = daily.where(F.col(site).isin(sites)).groupBy(site, F.year(when).alias("year"), F.month(when).alias("month"))
    counts = stage(grouped.agg(F.count(F.lit(1)).alias("valid_count"), F.avg(value).alias("mean")), "daily_months")
    grid = grid_fill(counts, counts, "year", {site: sites, "month": list(range(1, 13))}, "valid_count")
    gated = gate(grid, cutoff, per_month).join(counts.select(site, "year", "month", "mean"), [site, "year", "month"], "left")
    return gated.withColumn("mean", F.when(F.col("valid"), F.col("mean")))


def across_sites(monthly: DataFrame, year: str, value: str) -> DataFrame:
    """Mean over sites of their gated monthly means."""
    return group_mean(monthly, [year, "month"], value)


def hourly_profile(readings: DataFrame, site: str, sites: list[str], year: str, value: str,
                   months: tuple[int, int] = (1, 12)) -> DataFrame:
    """Mean by local time of day: per site first, then over the listed sites."""
    chosen = readings.where(F.col(site).isin(sites) & in_month_range(F.month("local_date"), *months))
    profile = mean_of_means(chosen, [site], [year, "local_time"], value)
    return profile.withColumn("hour", fractional_hour_text("local_time"))


def daily_selection(
    daily: DataFrame, sites: list[str] = DAILY_ORDER, methods: list[str] = DAILY_METHODS, source: str = DAILY_SOURCE
) -> DataFrame:
    """Rows of listed sites measured by an accepted method or delivered by the accepted source."""
    accepted = F.col("method").isin(methods) | (F.col("source") == source)
    return daily.where(F.col("site").isin(sites) & accepted)


def validity_table(gates: DataFrame, period: str, site: str, sites: list[str] | None = None) -> DataFrame:
    """Percentage of readings, one row per period and one column per site."""
    return pivot_mean(gates, [period], site, sites, "valid_pct", 0.0)


def site_month_table(monthly: DataFrame, site: str, year: str, value: str, order: list[str],
                     months: list[datetime.date] | None = None) -> DataFrame:
    """Sites in report order, one column per month from oldest to newest."""
    dated = monthly.withColumn("_month", F.make_date(F.col(year), F.col("month"), F.lit(1)))
    return in_given_order(month_columns(dated, [site], "_month", months, value), site, order)
