"""Hourly traffic counts: page table to long rows, day types, year-over-year tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.functions.dates import with_day_type
from citylens.functions.rules import first_match
from citylens.operators.aggregates import group_mean, group_sum
from citylens.operators.windows import all_present, year_columns
from citylens.session import parameter_table, stage
from citylens.sources.markup import long_table

# Body rows per direction block, and the blocks in order.
BLOCK_ROWS = 38
DIRECTIONS = ["All", "Northbound", "Southbound"]
# Summary columns of the count table.
SUMMARY_COLUMNS = "Workday|7 Day|Count"
# City holidays.
HOLIDAYS = [
    "2024-01-01", "2024-01-15", "2024-02-12", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04",
    "2024-09-02", "2024-10-14", "2024-11-05", "2024-11-11", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-12", "2025-02-17", "2025-05-26", "2025-06-19", "2025-07-04",
    "2025-09-01", "2025-10-13", "2025-11-04", "2025-11-11", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-12", "2026-02-16", "2026-05-25", "2026-06-19", "2026-07-03",
    "2026-09-07", "2026-10-12", "2026-11-03", "2026-11-11", "2026-11-26",
]
# End of fixed values.
COMPARED_DAYS = ["weekend", "non-holiday weekday"]


def holiday_table(spark: SparkSession, days: list[str] = HOLIDAYS) -> DataFrame:
    text = parameter_table(spark, "holiday string", [(d,) for d in days])
    return text.select(F.to_date("holiday").alias("holiday"))


def block_label(pos: str, labels: list[str] = DIRECTIONS, size: int = BLOCK_ROWS):
    """Label of the position block a row falls in; rows past the last block get NULL."""
    return first_match([(F.col(pos) < (i + 1) * size, label) for i, label in enumerate(labels)])


def counts_from_pages(pages: DataFrame, html: str = "html", labels: list[str] = DIRECTIONS, size: int = BLOCK_ROWS) -> DataFrame:
    """Long hourly counts ``(…, hour, direction, date, count)`` from count-table pages.

    Each page is taken apart on its own row.  Its body holds one block of ``size`` rows for each of ``labels``; rows past
    the last block belong to none and go.  Summary rows have no time of day in the first
    column, summary columns have a summary name; both go.  An empty cell stays as a missing count.
    """
    cells = long_table(pages, html)
    kept = [c for c in pages.columns if c != html]
    wanted = (
        (F.col("pos") < size * len(labels))
        & F.col("first").rlike(r"^\d{2}:\d{2}:\d{2}")
        & F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}")
        & ~F.col("name").rlike(SUMMARY_COLUMNS)
    )
    return cells.where(wanted).select(
        *kept, F.col("first").alias("hour"), block_label("pos", labels, size).alias("direction"),
        F.to_date(F.substring("name", 1, 10)).alias("date"), F.col("item").cast("double").alias("count"),
    )


def hour_cells(counts: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row per date, direction and hour with day type, validity and calendar parts.

    ``total`` and ``n`` are the sum and number of counts in the cell.  The raw rows are read once;
    a date is valid when no count is missing in any of its directions, which is found and joined
    back on the cells.
    """
    present = F.bool_and(F.col("count").isNotNull())
    cells = counts.groupBy("date", "direction", "hour").agg(
        F.coalesce(F.sum("count"), F.lit(0.0)).alias("total"), F.count("count").alias("n"), present.alias("_whole")
    )
    cells = stage(cells.withColumn("_whole", F.when(F.col("_whole"), True)), "hour_cells")
    checked = all_present(cells, ["date"], "_whole", "valid").drop("_whole")
    typed = with_day_type(checked, "date", holidays)
    return typed.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")})


def classify_counts(counts: DataFrame, holidays: DataFrame) -> DataFrame:
    """Add day type, validity of the whole date and calendar parts to every raw row."""
    checked = all_present(with_day_type(counts, "date", holidays), ["date"], "count", "valid")
    return checked.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date")})


def usable(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("valid") & F.col("day_type").isin(COMPARED_DAYS))


def daily_totals(cells: DataFrame) -> DataFrame:
    """Vehicles per valid day and direction."""
    keys = ["year", "month", "day", "direction", "day_type"]
    return group_sum(usable(cells), keys, {"count": "total"}, keep_missing=False)


def monthly_comparison(daily: DataFrame, years: list[int]) -> DataFrame:
    """Mean daily totals per month, years side by side with their change."""
    monthly = group_mean(daily, ["direction", "day_type", "year", "month"], "count")
    return year_columns(monthly, ["direction", "day_type", "month"], "year", "count", years)


def hourly_comparison(cells: DataFrame, years: list[int]) -> DataFrame:
    """Mean counts per hour of day, years side by side with their change."""
    keys = ["direction", "day_type", "year", "hour"]
    sums = group_sum(usable(cells), keys, {"total": "total", "n": "n"}, keep_missing=False)
    hourly = sums.select(*keys, F.try_divide("total", "n").alias("count"))
    return year_columns(hourly, ["direction", "day_type", "hour"], "year", "count", years)
