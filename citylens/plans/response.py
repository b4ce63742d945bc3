"""Emergency response times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.functions.dates import seconds_between
from citylens.functions.rules import label_by_sets
from citylens.functions.text import try_int_commas
from citylens.operators.aggregates import count_where, mean_nonzero, percent

# Dispatch areas of each report area and the codes of life-threatening calls.
DISPATCH_AREAS = {
    "cbd": ["M1", "M2", "M3"],
    "non_cbd_mnh": ["M4", "M5", "M6", "M7", "M8", "M9"],
    "bronx": ["B1", "B2", "B3", "B4", "B5"],
    "brooklyn": ["K1", "K2", "K3", "K4", "K5", "K6", "K7"],
    "queens": ["Q1", "Q2", "Q3", "Q4", "Q5", "Q6", "Q7"],
    "staten_island": ["S1", "S2", "S3"],
}
LIFE_THREAT = ["1", "2", "3"]
# End of fixed values.


def with_seconds(incidents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Comma-grouped seconds text to integers, ``{output: column}``; bad text is NULL."""
    return incidents.withColumns({out: try_int_commas(c) for out, c in columns.items()})


def zero_counts(incidents: DataFrame, start: str = "incident_at") -> DataFrame:
    """Incidents per year whose travel or response time is recorded as zero."""
    counted = incidents.groupBy(F.year(start).alias("year")).agg(
        count_where(F.col("travel_s") == 0).alias("invalid_travel_time_count"),
        count_where(F.col("response_s") == 0).alias("invalid_response_time_count"),
        F.count(F.lit(1)).alias("total_entries"),
    )
    share = percent(F.col("invalid_travel_time_count"), F.col("total_entries"))
    return counted.withColumn("invalid_travel_time_count_pct", share)


def response_times(
    incidents: DataFrame,
    areas: dict[str, list] = DISPATCH_AREAS,
    life_threat: list = LIFE_THREAT,
    years: list[int] | None = None,
    start: str = "incident_at",
) -> DataFrame:
    """Mean times by year, month, area and severity in one aggregation.

    Zeros count as missing, except in the gap between assignment and activation.  Dispatch areas
    outside the list form the NULL area.  A year list also bounds the raw timestamps, which lets the
    scan skip files and row groups.
    """
    if years is not None:
        kind = incidents.schema[start].dataType
        first, after = (F.lit(f"{y}-01-01 00:00:00").cast(kind) for y in (min(years), max(years) + 1))
        incidents = incidents.where((F.col(start) >= first) & (F.col(start) < after))
    grouped = incidents.groupBy(
        F.year(start).alias("year"), F.month(start).alias("month"),
        label_by_sets(F.col("dispatch_area"), areas).alias("area_type"),
        label_by_sets(F.col("severity_code"), {"life_threat": life_threat}, "non_life_threat").alias("init_severity"),
    ).agg(
        mean_nonzero("travel_s").alias("average_travel_time"),
        mean_nonzero("response_s").alias("average_response_time"),
        mean_nonzero("dispatch_s").alias("average_official_dispatch_time"),
        F.avg(seconds_between("assigned_at", "activated_at")).alias("average_activation_seconds"),
        F.count(F.lit(1)).alias("num_of_entries"),
    )
    spent = F.col("average_response_time") - F.col("average_travel_time")
    result = grouped.withColumns({
        "average_calculated_dispatch_time": spent,
        "pct_calculated_dispatch": percent(spent, F.col("average_response_time")),
        "pct_official_dispatch": percent(F.col("average_official_dispatch_time"), F.col("average_response_time")),
    })
    return result if years is None else result.where(F.col("year").isin(years))
