"""Grouped sums, means, subtotals and distinct counts.

All of these are plain ``groupBy().agg()`` with partial aggregation before the shuffle, so one
group holding most of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys) if keys else df


def group_sum(df: DataFrame, keys: list[str], sums: dict[str, str], keep_missing: bool = True) -> DataFrame:
    """Sums by group, ``{output: column}``.

    ``keep_missing=False`` drops groups with a missing key and gives 0 for all-missing values (the
    data-frame convention); otherwise a missing key is a group and such a sum is NULL (SQL).
    """
    if keep_missing:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(out) for out, c in sums.items()])
    zero = {out: F.coalesce(F.sum(c), F.lit(0)) for out, c in sums.items()}
    return drop_missing_keys(df, keys).groupBy(*keys).agg(*[v.alias(out) for out, v in zero.items()])


def group_size(df: DataFrame, keys: list[str], out: str = "count", keep_missing: bool = True) -> DataFrame:
    base = df if keep_missing else drop_missing_keys(df, keys)
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def group_mean(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """Mean by group; rows with a missing key are dropped, missing values skipped."""
    return drop_missing_keys(df, keys).groupBy(*keys).agg(F.avg(value).alias(out or value))


def mean_of_means(df: DataFrame, unit: list[str], keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """Mean over units of per-unit means, so that every unit weighs the same."""
    return group_mean(group_mean(df, unit + keys, value, "_mean"), keys, "_mean", out or value)


def sum_then_mean(df: DataFrame, fine: list[str], coarse: list[str], value: str, out: str | None = None) -> DataFrame:
    """Sum within fine groups, then the mean of those sums within coarse groups."""
    sums = group_sum(df, fine, {"_sum": value}, keep_missing=False)
    return group_mean(sums, coarse, "_sum", out or value)


def count_where(condition: Column) -> Column:
    """SUM(CASE WHEN … THEN 1 ELSE 0 END), 0 for a group where it never holds."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def mean_nonzero(column: str) -> Column:
    """Mean with zero read as missing."""
    return F.avg(F.nullif(F.col(column), F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL for a zero or missing whole."""
    return F.try_divide(part, whole) * F.lit(100)


def with_subtotals(
    df: DataFrame,
    keys: list[str],
    label: str,
    value: str,
    members: dict[str, list[str] | None],
    keep: list[str] | None = None,
) -> DataFrame:
    """Detail rows plus named subtotal rows in one aggregation.

    ``members`` maps a subtotal name to the labels it adds up (None for all); subtotals may overlap.
    ``keep`` lists the labels whose own rows stay (None for all).
    """
    own = F.lit(True) if keep is None else F.col(label).isin(keep)
    tags = [F.when(own, F.col(label))]
    for name, labels in members.items():
        belongs = F.lit(True) if labels is None else F.col(label).isin(labels)
        tags.append(F.when(belongs, F.lit(name)))
    rows = df.withColumn("_tag", F.explode(F.array_compact(F.array(*tags))))
    return rows.groupBy(*keys, F.col("_tag").alias(label)).agg(F.sum(value).alias(value))


def distinct_grid(df: DataFrame, row: str, column: str, ids: str, rows: DataFrame, columns: list) -> DataFrame:
    """Distinct ids per row label x column label, 0 where there are none.

    ``rows`` lists the wanted row labels in column ``row``; one aggregation answers all cells.
    Other column labels are left to the pivot: a filter here would be pushed below the expressions
    that make the label and evaluate them twice.
    """
    counted = (
        df.groupBy(row, column).agg(F.count_distinct(ids).alias("_n"))
        .groupBy(row).pivot(column, columns).agg(F.first("_n"))
    )
    return rows.select(row).join(counted, row, "left").fillna(0, subset=[str(c) for c in columns])
