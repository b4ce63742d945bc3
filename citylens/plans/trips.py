"""Origin-destination matrices, zone flows by month and boardings per board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.functions.text import natural_order, thousands
from citylens.operators import geo
from citylens.operators.aggregates import group_sum
from citylens.operators.joins import lookup_all, salted_join, within_distance, zone_flags
from citylens.operators.reshape import pivot_once
from citylens.plans.places import NOT_NEAREST
from citylens.session import stage, together
from citylens.sinks.writers import grow_once

WEEKS_PER_MONTH = 4.348  # fixed value: factor from a weekly estimate


def end_points(rows: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """Distinct points of several trip ends in one pass: ``(x, y)`` and one flag per end."""
    each = ", ".join(
        f"struct(CAST(`{x}` AS DOUBLE) AS x, CAST(`{y}` AS DOUBLE) AS y, '{end}' AS end)" for end, (x, y) in ends.items()
    )
    points = rows.selectExpr(f"inline(array({each}))").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    flags = [F.bool_or(F.col("end") == end).alias(end) for end in ends]
    return stage(points.groupBy("x", "y").agg(*flags), "points")


def attach_end(rows: DataFrame, labels: DataFrame, xy: tuple[str, str], out: str, tolerance: float | None) -> DataFrame:
    """Attach the region of one trip end; rows without a labelled point drop out.

    ``tolerance`` matches labelled points within that distance, so near-duplicate points multiply
    rows; None matches equal coordinates.
    """
    if tolerance is None:
        return geo.label_points(rows, labels, xy, out, "inner")
    near = labels.select(F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col("region").alias(out))
    return within_distance(rows, near, xy, ("_lx", "_ly"), tolerance).drop("_lx", "_ly")


def regions_key(regions: DataFrame, exclude: list[str] = ()) -> str:
    """Names a set of regions by its content, so that stored labels of other regions are not used."""
    return regions.where(~F.col("region").isin(list(exclude)) if exclude else F.lit(True)).agg(
        F.hex(F.bit_xor(F.xxhash64("region", "wkt"))), F.count(F.lit(1))).selectExpr("concat_ws('-', *)").first()[0]


def od_flow(
    trips: DataFrame,
    regions: DataFrame,
    origin: tuple[str, str] = ("ox", "oy"),
    destination: tuple[str, str] = ("dx", "dy"),
    weight: str | None = None,
    factor: float = 1.0,
    out: str = "rides",
    exclude: list[str] = NOT_NEAREST,
    origin_tolerance: float | None = 1e-6,
    destination_tolerance: float | None = None,
    cell: float = geo.CELL,
    ties: str = "all",
    label_path: str | None = None,
    refresh: bool = False,
) -> DataFrame:
    """Region x region flow: trips counted, or a weight summed and scaled.

    Trips are first added up per pair of end points.  Labels depend on the points alone, so the
    result is the same, and only distinct pairs reach the joins however many trips share a station.
    Trips with an end that gets no label drop out.  ``label_path`` keeps the label table of these
    regions for later runs, which label only points it does not have; ``refresh`` labels all again.
    """
    ends = [*origin, *destination]
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    index = geo.RegionIndex(geo.drop_regions(regions, exclude), cell)

    def summed() -> tuple[DataFrame, DataFrame]:
        sums = stage(trips.groupBy(*ends).agg(measure.alias("_w")), "pairs")
        return sums, end_points(sums, {"origin": origin, "destination": destination})

    (pairs, points), _ = together(summed, index.build)

    def nearest(asked: DataFrame) -> DataFrame:
        return geo.nearest_regions(asked, index, ties).drop("distance")

    if label_path is None:
        found = nearest(points.select("x", "y"))
    else:
        found = grow_once(points, ["x", "y"], f"{label_path}/{regions_key(regions, exclude)}-{ties}", nearest, refresh)
    labels = stage(found.join(points, ["x", "y"]), "labels")
    one = attach_end(pairs, labels.where("origin"), origin, "origin_region", origin_tolerance)
    # pairs sharing a region at one end are merged before the other end is looked up
    one = one.groupBy("origin_region", *destination).agg(F.sum("_w").alias("_w"))
    both = attach_end(one, labels.where("destination"), destination, "destination_region", destination_tolerance)
    total = F.sum("_w") if weight is None else F.sum("_w") * F.lit(factor)
    return both.groupBy("origin_region", "destination_region").agg(total.alias(out))


def named_flow(flow: DataFrame, labels: DataFrame) -> DataFrame:
    """Region codes of both ends replaced by display names where there is one."""
    named = lookup_all(flow, {"origin_region": "origin", "destination_region": "destination"}, labels)
    return named.drop("origin_region", "destination_region")


def flow_lines(flow: DataFrame, origin: str, destination_part: str, value: str) -> DataFrame:
    """Readable lines for one origin and destinations whose name contains a text."""
    chosen = flow.where((F.col("origin") == origin) & F.col("destination").contains(destination_part))
    line = F.concat(F.col("origin"), F.lit(" to "), F.col("destination"), F.lit(": "), thousands(value), F.lit(" trips"))
    return chosen.select("origin", "destination", line.alias("line"))


def flow_matrix(flow: DataFrame, names: list[str] | None, value: str, order: bool = True) -> DataFrame:
    """Long flow to a matrix with one column per destination name (by default all), both in natural order."""
    wide = pivot_once(flow, ["origin"], "destination", names, value)
    return wide.orderBy(*natural_order("origin")) if order else wide


def zone_months(
    trips: DataFrame, month: Column, start_name: str, end_name: str, zones: DataFrame,
    tag: dict[str, object] | None = None, weight: str | None = None,
) -> DataFrame:
    """Monthly trips into, out of and inside the business district in one pass over the trips.

    The year of the report is the source's tag, not the timestamp's year.  ``weight`` is the number
    of trips a row stands for, when trips were added up beforehand.
    """
    flagged = zone_flags(trips, start_name, zones, {"cbd": "s_cbd", "other_manhattan": "s_mnh", "outside_cbd": "s_out"})
    flagged = zone_flags(flagged, end_name, zones, {"cbd": "e_cbd", "outside_cbd": "e_out"})
    keys = [F.lit(v).alias(k) for k, v in (tag or {}).items()]
    number = F.lit(1).cast("bigint") if weight is None else F.col(weight)

    def total(start: str, end: str, out: str) -> Column:
        return F.sum(F.when(F.col(start) & F.col(end), number).otherwise(0)).alias(out)

    return flagged.groupBy(*keys, month.alias("month")).agg(
        total("s_out", "e_cbd", "non_cbd_to_cbd"),
        total("s_cbd", "e_out", "cbd_to_non_cbd"),
        total("s_mnh", "e_cbd", "non_cbd_mnh_to_cbd_mnh"),
        total("s_cbd", "e_cbd", "within_cbd"),
        F.sum(number).alias("total_trips"),
    )


def located_zone_months(
    trips: DataFrame, start_time: str, start: tuple[str, str], end: tuple[str, str], index: geo.RegionIndex, zones: DataFrame,
    tag: dict[str, object] | None = None, label_path: str | None = None, refresh: bool = False,
) -> DataFrame:
    """``zone_months`` from coordinates.

    Trips are counted per month and pair of end points first, so a busy dock is a few rows by the
    time neighbourhoods are attached.
    """
    pairs = stage(trips.groupBy(F.month(start_time).alias("month"), *start, *end).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    named = with_neighbourhoods(pairs, {"start_nta": start, "end_nta": end}, index, label_path, refresh)
    return zone_months(named, F.col("month"), "start_nta", "end_nta", zones, tag, "_n")


def zone_years(
    sources: dict[int, DataFrame], start_time: str, start: tuple[str, str], end: tuple[str, str], index: geo.RegionIndex, zones: DataFrame,
    label_path: str | None = None, refresh: bool = False,
) -> DataFrame:
    """``located_zone_months`` of several yearly sources in one table, one row per source year and month.

    The year is the source's, whatever its timestamps say.  All years are counted in one pass and share one set of
    labels; ``label_path`` keeps them, and a year that comes later labels only its new points.
    """
    rows = [source.select(F.lit(year).alias("year"), F.col(start_time).alias("_time"), *start, *end) for year, source in sources.items()]
    stacked = reduce(DataFrame.unionByName, rows)
    pairs = stage(stacked.groupBy("year", F.month("_time").alias("month"), *start, *end).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    named = with_neighbourhoods(pairs, {"start_nta": start, "end_nta": end}, index, label_path, refresh)
    return zone_months(named, F.col("month"), "start_nta", "end_nta", zones, {"year": F.col("year")}, "_n")


def with_neighbourhoods(
    trips: DataFrame, ends: dict[str, tuple[str, str]], index: geo.RegionIndex, label_path: str | None = None,
    refresh: bool = False,
) -> DataFrame:
    """Neighbourhood strictly containing each trip end, ``{output: (x, y)}``; NULL outside all.

    The smallest name is taken if there are several.  Points of all ends are tested together.  Labels
    stored under ``label_path`` are extended by points that are new; the path belongs to one set of regions.
    """
    points = end_points(trips, {f"end{i}": xy for i, xy in enumerate(ends.values())}).select("x", "y")
    if label_path is None:
        named = stage(geo.within_regions(points, index), "labels")
    else:
        named = grow_once(points, ["x", "y"], label_path, lambda asked: geo.within_regions(asked, index), refresh)
    for out, xy in ends.items():
        trips = geo.label_points(trips, named, xy, out, "left", "min")
    return trips


def board_totals(
    stops: DataFrame, regions: DataFrame, xy: tuple[str, str], sums: dict[str, str], exclude: list[str] = NOT_NEAREST,
    cell: float = geo.CELL,
) -> DataFrame:
    """Ridership sums per community board; stops without a point form the NULL board.

    Stops are added up per point before labels are attached.
    """
    index = geo.RegionIndex(geo.drop_regions(regions, exclude), cell)
    per_point, _ = together(
        lambda: stage(group_sum(stops, list(xy), {c: c for c in sums.values()}), "per_point"),
        index.build,
    )
    labels = geo.nearest_regions(geo.distinct_points(per_point, *xy), index, ties="first")
    labelled = geo.label_points(per_point, labels, xy, "community_board", "left")
    return group_sum(labelled, ["community_board"], sums)
