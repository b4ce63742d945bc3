"""Pivot, unpivot, zero-filled grids and given orders.

Pivots take their column values as a parameter or find them in one pass: the cells of an index row become a map, the
maps are written, and the columns are read from them.  No value is lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.session import parameter_table, stage


def in_natural_order(values: list) -> list:
    """Texts by their numbers and letters, other values by size."""
    digits = lambda v: [(0, int(t), "") if t.isdigit() else (1, 0, t) for t in re.findall(r"\d+|\D+", v)]
    return sorted(values, key=digits if all(isinstance(v, str) for v in values) else None)


def pivot_found(
    df: DataFrame, index: list[str], column: str, cell: Column, order: Callable[[list], list] = in_natural_order,
    name: Callable[[object], str] | None = None,
) -> tuple[DataFrame, list]:
    """Long to wide with a column for every value found; returns the result and the values in order.

    ``df`` is evaluated once: ``cell`` is aggregated per index row and value, the cells of an index row become a map
    (as many entries as the result has columns), and the list of values is read from the written maps.  A missing value makes no column, its index row stays.
    """
    kind = df.schema[column].dataType
    cells = df.groupBy(*index, column).agg(cell.alias("_cell"))
    entry = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("key"), F.col("_cell").alias("value")))
    rows = stage(cells.groupBy(*index).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells")), "pivot")
    # the list of the result's columns, which a plan must know
    found = rows.select(F.explode(F.map_keys("_cells")).alias("key")).distinct().select("key", F.col("key").cast("string")).collect()
    texts, ordered = dict(found), order([key for key, _ in found])
    label = name or (lambda value: texts[value])
    wide = [F.try_element_at("_cells", F.lit(v).cast(kind)).alias(label(v)) for v in ordered]
    return rows.select(*[F.col(f"`{c}`") for c in index], *wide), ordered


def listed_only(df: DataFrame, column: str, values: list) -> DataFrame:
    """The same rows; a value of ``column`` that is not listed is an error, so no pivot drops it unseen."""
    value = F.col(column)
    message = F.concat(F.lit(f"value of {column} without a column in the pivot: "), value.cast("string"))
    return df.withColumn(column, F.when(value.isNull() | value.isin(values), value).otherwise(F.raise_error(message)))


def only_cell(column: str, value: str) -> Column:
    """The value of a cell; a second row in it is an error."""
    return F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"more than one row in a cell of the pivot on {column}"))
    ).otherwise(F.first(value))


def pivot_once(df: DataFrame, index: list[str], column: str, values: list | None, value: str) -> DataFrame:
    """Long to wide with at most one row per cell; a second one is an error.

    ``values`` are the columns in order, by default all values found.  A value that is not listed is an error.
    """
    if values is None:
        return pivot_found(df, index, column, only_cell(column, value))[0]
    return listed_only(df, column, values).groupBy(*index).pivot(column, values).agg(only_cell(column, value))


def pivot_mean(df: DataFrame, index: list[str], column: str, values: list | None, value: str, fill: float | None = 0.0) -> DataFrame:
    """Long to wide with the mean per cell; empty cells get ``fill``.  Columns are chosen as in ``pivot_once``."""
    if values is None:
        wide = pivot_found(df, index, column, F.avg(value))[0]
    else:
        wide = listed_only(df, column, values).groupBy(*index).pivot(column, values).agg(F.avg(value))
    return wide if fill is None else wide.fillna(fill, subset=[c for c in wide.columns if c not in index])


def unpivot_long(df: DataFrame, ids: list[str], values: list[str] | None, name: str, value: str) -> DataFrame:
    """Wide to long; missing cells stay as rows."""
    columns = values if values is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, [F.col(f"`{c}`") for c in columns], name, value)


def grid_fill(
    counts: DataFrame,
    seen: DataFrame,
    axis: str,
    fixed: dict[str, list] | None = None,
    value: str = "count",
    fill: object = 0,
) -> DataFrame:
    """Every combination of axis values, with ``fill`` where ``counts`` has no row.

    Values of the open ``axis`` are those present in ``seen``, however many: they stay distributed
    rows.  The ``fixed`` axes are given lists, exploded on those rows.
    """
    grid = seen.select(axis).distinct()
    for name, values in (fixed or {}).items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [axis, *(fixed or {})]
    same = [F.col(f"g.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]
    filled = grid.alias("g").join(counts.alias("c"), same, "left")
    return filled.select(*[F.col(f"g.`{k}`") for k in keys], F.coalesce(F.col(f"c.`{value}`"), F.lit(fill)).alias(value))


def in_given_order(df: DataFrame, key: str, order: list, fill: object = None, fill_columns: list[str] | None = None) -> DataFrame:
    """Exactly the listed keys, in a ``position`` column's order.

    Absent keys are added.  ``fill`` goes into the added rows only: gaps that were already in the
    data stay NULL.
    """
    dtype = df.schema[key].dataType.simpleString()
    wanted = parameter_table(df.sparkSession, f"{key} {dtype}, position int", [(k, i) for i, k in enumerate(order)])
    joined = wanted.join(df.withColumn("_had", F.lit(True)), key, "left")
    if fill is not None:
        columns = fill_columns or [c for c in df.columns if c != key]
        joined = joined.withColumns({
            c: F.when(F.col("_had").isNull(), F.lit(fill)).otherwise(F.col(f"`{c}`")) for c in columns
        })
    return joined.select(key, *[F.col(f"`{c}`") for c in df.columns if c != key], "position")


def month_columns(df: DataFrame, index: list[str], month: str, months: list | None, value: str) -> DataFrame:
    """Wide table with one column per first-of-month date, oldest first, named ``M/yyyy``.

    By default all months found; a month that is not listed is an error.
    """
    name = lambda m: f"{m.month}/{m.year}"
    if months is None:
        return pivot_found(df, index, month, only_cell(month, value), sorted, name)[0]
    label = F.date_format(F.col(month), "M/yyyy")
    return pivot_once(df.withColumn("_label", label), index, "_label", [name(m) for m in sorted(months)], value)
