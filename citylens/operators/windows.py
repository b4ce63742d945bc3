"""Least-per-group filters, change over time and completeness gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citylens.operators.joins import salted_join
from citylens.operators.reshape import grid_fill, only_cell, pivot_found, pivot_once
from citylens.session import stage


def least_per_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows at the minimum of ``value`` in their group, ties kept, missing values never kept.

    The minimum is aggregated (partially, before the shuffle) and joined back with salted keys, so
    neither a huge group nor a huge tie is ever gathered in one task.
    """
    known = df.where(F.col(value).isNotNull())
    least = known.groupBy(*keys).agg(F.min(value).alias(value))
    return salted_join(known, least, [*keys, value], "left_semi", null_safe=True)


def change_percent(df: DataFrame, series: list[str], order: str, value: str, lag: int = 1, out: str = "pct_change") -> DataFrame:
    """Percent change against ``lag`` rows earlier in the series; NULL where that was 0 or absent.

    Meant for aggregated rows: a series is one row per period.
    """
    before = F.lag(value, lag).over(W.partitionBy(*series).orderBy(order))
    current = F.col(value).cast("double")
    return df.withColumn("_before", before.cast("double")).withColumn(
        out, F.try_divide(current - F.col("_before"), F.col("_before")) * 100
    ).drop("_before")


def year_columns(df: DataFrame, index: list[str], year: str, value: str, years: list[int] | None, digits: int = 2) -> DataFrame:
    """Years side by side and the percent change between neighbours.

    By default all years found.  A second row in a cell and a year that is not listed are errors.
    Half-way digits go to the even neighbour.  A zero base gives NULL.
    """
    if years is None:
        wide, years = pivot_found(df, index, year, only_cell(year, value))
    else:
        wide = pivot_once(df, index, year, years, value)
    changes = {}
    for old, new in zip(years, years[1:]):
        a, b = F.col(f"`{old}`").cast("double"), F.col(f"`{new}`").cast("double")
        changes[f"yoy_{old}_{new}"] = F.bround((b - a) / F.nullif(a, F.lit(0.0)) * 100, digits)
    return wide.withColumns(changes)


def completeness(
    df: DataFrame,
    site: str,
    period: str,
    sites: list[str],
    cutoff: float,
    per_period: int,
) -> DataFrame:
    """Rows per site and period with a validity gate.

    Every listed site appears with every period seen in the data, count 0 where it has no rows.
    Rows count whether or not their value is missing, and the percentage may exceed 100.
    """
    # one pass over the rows; the few counts serve both as cells and as the list of periods
    counts = stage(df.groupBy(site, period).agg(F.count(F.lit(1)).alias("valid_count")), "period_counts")
    grid = grid_fill(counts, counts, period, {site: sites}, "valid_count")
    return gate(grid, cutoff, per_period)


def gate(counts: DataFrame, cutoff: float, per_period: int) -> DataFrame:
    """Add cutoff, valid flag and percentage to per-period counts."""
    return counts.withColumns({
        "cutoff": F.lit(float(cutoff)),
        "valid": F.col("valid_count") >= F.lit(float(cutoff)),
        "valid_pct": F.bround(F.col("valid_count") / F.lit(per_period) * 100, 2),
    })


def gated_mean(means: DataFrame, gates: DataFrame, on: list[str], value: str, drop: bool = False) -> DataFrame:
    """Means of valid periods only: others are dropped or kept with a NULL mean."""
    good = gates.where("valid").select(*on).distinct()
    if drop:
        return means.join(good, on, "left_semi")
    marked = means.join(good.withColumn("_ok", F.lit(True)), on, "left")
    return marked.withColumn(value, F.when(F.col("_ok"), F.col(value))).drop("_ok")


def complete_groups(df: DataFrame, keys: list[str], value: str, out: str = "valid") -> DataFrame:
    """One row per group: whether no value in it is missing."""
    return df.groupBy(*keys).agg(F.bool_and(F.col(value).isNotNull()).alias(out))


def all_present(df: DataFrame, keys: list[str], value: str, out: str = "valid") -> DataFrame:
    """Flag every row by whether no value in its group is missing.

    Aggregate and join back rather than a window, so a hot group is never gathered in one task.
    """
    return salted_join(df, complete_groups(df, keys, value, out), keys, "left")
