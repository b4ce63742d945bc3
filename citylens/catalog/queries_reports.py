"""Whole analyses over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from citylens.catalog import bindings as b
from citylens.catalog.queries_basic import NAMED_SQL, VEHICLES_SQL, _vehicles, _zones, named_trips
from citylens.catalog.queries_geo import BOX_IN, BOX_ON, groups, index
from citylens.catalog.queries_summaries import (
    COMPLETE_SQL, DAILY_TOTAL_SQL, GATED_SQL, PAIR, SHOWN_SITES, USABLE_SQL, gated, hour_cells, rounded_years, seconds,
    side_by_side,
)
from citylens.catalog.registry import query, table
from citylens.functions.text import cast_commas
from citylens.operators import geo
from citylens.operators.windows import completeness
from citylens.plans import air, crashes, response, traffic, trips
from citylens.session import parameter_table

# --- trips ---------------------------------------------------------------------------------------------

KEPT_REGIONS = ["r1", "r3", "r4"]


def _nearest_kept(x, y):
    return b.nearest_sql(x, y).replace("QUALIFY", "WHERE region <> 'r2' QUALIFY", 1)


SUBWAY_SQL = f"""(SELECT o.region AS origin, d.region AS destination,
    sum(CAST(replace(weight_text, ',', '') AS DOUBLE)) * 4.348 AS riders FROM {b.TRIPS_SQL} t
    JOIN {_nearest_kept("ox", "oy")} o ON t.ox = o.x AND t.oy = o.y
    JOIN {_nearest_kept("dx", "dy")} d ON t.dx = d.x AND t.dy = d.y GROUP BY ALL)"""
NAMES = [("r1", "Manhattan Community Board 10"), ("r3", "Manhattan Community Board 9")]
NAMED = "CASE {c} WHEN 'r1' THEN 'Manhattan Community Board 10' WHEN 'r3' THEN 'Manhattan Community Board 9' ELSE {c} END"


def subway(spark, sf):
    rows = b.trips(spark, sf).withColumn("weight", cast_commas("weight_text"))
    return trips.od_flow(
        rows, b.rectangles(spark), weight="weight", factor=trips.WEEKS_PER_MONTH, out="riders", exclude=["r2"], cell=b.CELL
    )


@query("report_subway_flow", f"SELECT origin AS origin_region, destination AS destination_region, round(riders, 2) AS riders FROM {SUBWAY_SQL}")
def report_subway_flow(spark, sf):
    return subway(spark, sf).withColumn("riders", F.round("riders", 2))


@query("report_subway_matrix", f"SELECT {NAMED.format(c='origin')} AS origin, " + ", ".join(
    f"round(max(CASE WHEN destination = '{r}' THEN riders END), 2) AS \"{dict(NAMES).get(r, r)}\"" for r in KEPT_REGIONS
) + f" FROM {SUBWAY_SQL} GROUP BY ALL")
def report_subway_matrix(spark, sf):
    labels = parameter_table(spark, "code string, label string", NAMES)
    named = trips.named_flow(subway(spark, sf), labels).withColumn("riders", F.round("riders", 2))
    return trips.flow_matrix(named, None, "riders")


@query("report_bike_flow", f"""SELECT o.region AS origin_region, d.region AS destination_region, count(*) AS rides
    FROM {b.TRIPS_SQL} t JOIN {b.nearest_sql("ox", "oy")} o ON sqrt((t.ox - o.x) ** 2 + (t.oy - o.y) ** 2) <= 1e-6
    JOIN {b.nearest_sql("dx", "dy")} d ON sqrt((t.dx - d.x) ** 2 + (t.dy - d.y) ** 2) <= 1e-6 GROUP BY ALL""")
def report_bike_flow(spark, sf):
    return trips.od_flow(b.trips(spark, sf), b.rectangles(spark), exclude=[], destination_tolerance=1e-6, cell=b.CELL)


@query("report_zone_months", f"""SELECT 2024 AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(sum(CASE WHEN s <> 0 AND e = 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_to_cbd,
    CAST(sum(CASE WHEN s = 0 AND e <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS cbd_to_non_cbd,
    CAST(sum(CASE WHEN s = 1 AND e = 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_mnh_to_cbd_mnh,
    CAST(sum(CASE WHEN s = 0 AND e = 0 THEN 1 ELSE 0 END) AS BIGINT) AS within_cbd, count(*) AS total_trips
    FROM {NAMED_SQL} GROUP BY ALL""")
def report_zone_months(spark, sf):
    return trips.zone_months(named_trips(spark, sf), F.month("ts"), "start_name", "end_name", _zones(spark, sf), {"year": 2024})


def _inside_sql(x, y):
    return f"(SELECT x, y, region FROM (SELECT DISTINCT {x} AS x, {y} AS y FROM {b.TRIPS_SQL} t), {b.RECTANGLES_SQL} WHERE {BOX_IN})"


@query("report_bike_zones", f"""SELECT CAST(month(ts) AS INTEGER) AS month,
    CAST(sum(CASE WHEN s.region <> 'r1' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_to_cbd,
    CAST(sum(CASE WHEN s.region = 'r1' AND e.region <> 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS cbd_to_non_cbd,
    CAST(sum(CASE WHEN s.region = 'r2' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_mnh_to_cbd_mnh,
    CAST(sum(CASE WHEN s.region = 'r1' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS within_cbd, count(*) AS total_trips
    FROM {b.TRIPS_SQL} t LEFT JOIN {_inside_sql('ox', 'oy')} s ON t.ox = s.x AND t.oy = s.y
    LEFT JOIN {_inside_sql('dx', 'dy')} e ON t.dx = e.x AND t.dy = e.y GROUP BY ALL""")
def report_bike_zones(spark, sf):
    zones = parameter_table(
        spark, "name string, cbd boolean, other_manhattan boolean, outside_cbd boolean",
        [(name, name == "r1", name == "r2", name != "r1") for name, *_ in b.RECTANGLES],
    )
    return trips.located_zone_months(b.trips(spark, sf), "ts", ("ox", "oy"), ("dx", "dy"), index(spark), zones)


YEARS = list(range(1995, 2002))
# orders read as trips, by the year of their source
YEAR_TRIPS_SQL = """(SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderdate AS ts, CAST(o_custkey * 37 % 104 AS DOUBLE) / 8 AS ox,
    CAST(o_custkey * 53 % 104 AS DOUBLE) / 8 AS oy, CAST(o_orderkey * 37 % 104 AS DOUBLE) / 8 AS dx, CAST(o_orderkey * 53 % 104 AS DOUBLE) / 8 AS dy FROM orders)"""


def _inside_year_sql(x, y):
    return f"""(SELECT x, y, min(region) AS region FROM (SELECT DISTINCT {x} AS x, {y} AS y FROM {YEAR_TRIPS_SQL} t), {b.RECTANGLES_SQL} WHERE {BOX_IN} GROUP BY ALL)"""


@query("report_bike_years", f"""SELECT year, CAST(month(ts) AS INTEGER) AS month,
    CAST(sum(CASE WHEN s.region <> 'r1' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_to_cbd,
    CAST(sum(CASE WHEN s.region = 'r1' AND e.region <> 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS cbd_to_non_cbd,
    CAST(sum(CASE WHEN s.region = 'r2' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS non_cbd_mnh_to_cbd_mnh,
    CAST(sum(CASE WHEN s.region = 'r1' AND e.region = 'r1' THEN 1 ELSE 0 END) AS BIGINT) AS within_cbd, count(*) AS total_trips
    FROM {YEAR_TRIPS_SQL} t LEFT JOIN {_inside_year_sql('ox', 'oy')} s ON t.ox = s.x AND t.oy = s.y
    LEFT JOIN {_inside_year_sql('dx', 'dy')} e ON t.dx = e.x AND t.dy = e.y GROUP BY ALL""")
def report_bike_years(spark, sf):
    eighth = lambda c, factor: (F.col(c) * factor % 104).cast("double") / 8
    rows = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), eighth("o_custkey", 37).alias("ox"), eighth("o_custkey", 53).alias("oy"),
        eighth("o_orderkey", 37).alias("dx"), eighth("o_orderkey", 53).alias("dy"),
    )
    sources = {year: rows.where(F.year("ts") == year) for year in YEARS}
    zones = parameter_table(
        spark, "name string, cbd boolean, other_manhattan boolean, outside_cbd boolean",
        [(name, name == "r1", name == "r2", name != "r1") for name, *_ in b.RECTANGLES],
    )
    return trips.zone_years(sources, "ts", ("ox", "oy"), ("dx", "dy"), index(spark), zones)


STOPS_SQL = f"""(SELECT user_id AS ons, event_id % 17 AS offs, CASE WHEN event_id % 50 <> 0 THEN ox END AS x,
    CASE WHEN event_id % 50 <> 0 THEN oy END AS y FROM {b.TRIPS_SQL} t)"""


@query("report_stop_boardings", f"""SELECT region AS community_board, CAST(sum(ons) AS BIGINT) AS weekday_ons, CAST(sum(offs) AS BIGINT) AS weekday_offs
    FROM {STOPS_SQL} s LEFT JOIN (SELECT x, y, min(region) AS region FROM {_nearest_kept("ox", "oy")} GROUP BY ALL) n
    ON s.x = n.x AND s.y = n.y GROUP BY ALL""")
def report_stop_boardings(spark, sf):
    placed = F.col("event_id") % 50 != 0
    stops = b.trips(spark, sf).select(
        F.col("user_id").alias("ons"), (F.col("event_id") % 17).alias("offs"), F.when(placed, F.col("ox")).alias("x"),
        F.when(placed, F.col("oy")).alias("y"),
    )
    return trips.board_totals(stops, b.rectangles(spark), ("x", "y"), {"weekday_ons": "ons", "weekday_offs": "offs"}, ["r2"], b.CELL)


# --- crashes -------------------------------------------------------------------------------------------

AREAS = ["n1", "n2", "n3", "n4"]
TOTALS = {"Adjacent": ["n2", "n3", "n4"], "Zone": ["n1"], "Others": ["Other"], "City": None}


def _person_rows(spark, sf):
    rows = crashes.with_severity(b.persons(spark, sf), "SEVERITY", "PERSON_INJURY", "EMOTIONAL_STATUS", "COMPLAINT", "BODILY_INJURY")
    return rows.select("COLLISION_ID", "CRASH_DATE", "SEVERITY", "area")


MONTHLY_SQL = f"""(WITH dated AS (SELECT CAST(year(d) AS INTEGER) AS "CRASH_YEAR", CAST(month(d) AS INTEGER) AS "CRASH_MONTH", "SEVERITY",
    CASE WHEN area IN ('n1', 'n2', 'n3', 'n4') THEN area ELSE 'Other' END AS grouped FROM (SELECT area, {b.SEVERITY_SQL} AS "SEVERITY",
    try_strptime("CRASH_DATE", '%m/%d/%Y') AS d FROM {b.PERSONS_SQL}) WHERE d IS NOT NULL AND "SEVERITY" IN ('K', 'A', 'B', 'C')),
    grid AS (SELECT * FROM (SELECT DISTINCT "CRASH_YEAR" FROM dated), (SELECT DISTINCT "CRASH_MONTH" FROM dated),
    (SELECT DISTINCT "SEVERITY" FROM dated), (SELECT unnest(['n1', 'n2', 'n3', 'n4', 'Other']) AS grouped))
    SELECT "CRASH_YEAR", "CRASH_MONTH", "SEVERITY", grouped, coalesce(n, 0) AS count FROM grid
    LEFT JOIN (SELECT *, count(*) AS n FROM dated GROUP BY ALL) USING ("CRASH_YEAR", "CRASH_MONTH", "SEVERITY", grouped))"""
SUMMARY_SQL = f"""(SELECT "CRASH_YEAR", "CRASH_MONTH", "SEVERITY", tag AS grouped, CAST(sum(count) AS BIGINT) AS count FROM (
    SELECT *, grouped AS tag FROM {MONTHLY_SQL} WHERE grouped IN ('n2', 'n3', 'n4')
    UNION ALL SELECT *, 'Adjacent' FROM {MONTHLY_SQL} WHERE grouped IN ('n2', 'n3', 'n4')
    UNION ALL SELECT *, 'Zone' FROM {MONTHLY_SQL} WHERE grouped = 'n1'
    UNION ALL SELECT *, 'Others' FROM {MONTHLY_SQL} WHERE grouped = 'Other'
    UNION ALL SELECT *, 'City' FROM {MONTHLY_SQL}) GROUP BY ALL)"""


def _summary(spark, sf):
    return crashes.summary(crashes.monthly_counts(_person_rows(spark, sf), areas=AREAS), AREAS[1:], TOTALS)


@query("report_injury_summary", f"SELECT * FROM {SUMMARY_SQL}")
def report_injury_summary(spark, sf):
    return _summary(spark, sf)


@query("report_injury_yearly", f"""SELECT *, round(CAST(count - lag(count) OVER w AS DOUBLE) / nullif(lag(count) OVER w, 0) * 100, 6) AS pct_change
    FROM (SELECT "CRASH_YEAR", "SEVERITY", grouped, CAST(sum(count) AS BIGINT) AS count FROM {SUMMARY_SQL}
    WHERE grouped IN ('Adjacent', 'Zone', 'Others', 'City') GROUP BY ALL)
    WINDOW w AS (PARTITION BY "SEVERITY", grouped ORDER BY "CRASH_YEAR")""")
def report_injury_yearly(spark, sf):
    changed = crashes.yearly_change(_summary(spark, sf), list(TOTALS))
    return changed.withColumn("pct_change", F.round("pct_change", 6))


@query("report_distinct_crashes", "SELECT CAST(y AS INTEGER) AS crash_year, " + ", ".join(
    f"count(DISTINCT CASE WHEN s = '{k}' THEN id END) AS \"{k}\"" for k in crashes.SEVERITIES
) + f""" FROM (SELECT unnest(range(1995, 2002)) AS y) LEFT JOIN (SELECT "COLLISION_ID" AS id, {b.SEVERITY_SQL} AS s,
    year(try_strptime("CRASH_DATE", '%m/%d/%Y')) AS cy FROM {b.PERSONS_SQL}) ON cy = y GROUP BY ALL""")
def report_distinct_crashes(spark, sf):
    years = parameter_table(spark, "crash_year int", [(y,) for y in range(1995, 2002)])
    return crashes.distinct_crashes(_person_rows(spark, sf), years)


@query("report_located_injuries", f"""SELECT area, s AS severity, count(*) AS n FROM (SELECT DISTINCT person_id, s,
    CASE WHEN region IN ('r1', 'r2') THEN 'A' WHEN region = 'r3' THEN 'B' ELSE region END AS area
    FROM (SELECT person_id, {b.SEVERITY_SQL} AS s, CAST("COLLISION_ID" * 37 % 104 AS DOUBLE) / 8 AS x,
    CAST("COLLISION_ID" * 53 % 104 AS DOUBLE) / 8 AS y FROM {b.PERSONS_SQL})
    LEFT JOIN {b.RECTANGLES_SQL} ON {BOX_ON}) GROUP BY ALL""")
def report_located_injuries(spark, sf):
    key = F.col("c_custkey")
    places = table(spark, sf, "customer").select(
        key.alias("COLLISION_ID"), ((key * 37 % 104).cast("double") / 8).alias("LONGITUDE"),
        ((key * 53 % 104).cast("double") / 8).alias("LATITUDE"),
    )
    located = crashes.locate(crashes.classify_persons(b.persons(spark, sf).drop("area"), places), index(spark), groups(spark))
    return located.groupBy("area", F.col("SEVERITY").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


TAXI_SQL = f"""(SELECT *, CAST(o_orderkey * 37 % 104 AS DOUBLE) / 8 AS x, CAST(o_orderkey * 53 % 104 AS DOUBLE) / 8 AS y FROM {VEHICLES_SQL}
    WHERE (v1 = 'Taxi' OR v2 = 'Taxi' OR v3 = 'Taxi' OR v4 = 'Taxi' OR v5 = 'Taxi')
    AND (CAST(injured AS INTEGER) > 0 OR CAST(killed AS INTEGER) > 0))"""


@query("report_taxi_crashes", f"""SELECT CAST(year(strptime(crash_date, '%m/%d/%Y')) AS INTEGER) AS crash_year, count(*) AS taxi_count,
    count(CASE WHEN board IN ('r1') THEN 1 END) AS taxi_count_cbd, count(CASE WHEN board NOT IN ('r1') THEN 1 END) AS taxi_count_other
    FROM (SELECT o_orderkey, crash_date, min(region) AS board FROM {TAXI_SQL} LEFT JOIN {b.RECTANGLES_SQL} ON {BOX_ON} GROUP BY ALL)
    GROUP BY ALL""")
def report_taxi_crashes(spark, sf):
    key = F.col("o_orderkey")
    rows = _vehicles(spark, sf).withColumns({"x": (key * 37 % 104).cast("double") / 8, "y": (key * 53 % 104).cast("double") / 8})
    # only the crashes that count need a board
    labels = geo.intersecting_regions(geo.distinct_points(crashes.taxi_injuries(rows), "x", "y"), index(spark))
    return crashes.taxi_by_year(rows, labels, ["r1"])


# --- air -----------------------------------------------------------------------------------------------

HOURLY_CUTOFF = 10


def _hourly(spark, sf):
    return air.localize(b.hourly(spark, sf), "ts").withColumn("year", F.lit(2024))


@query("report_air_completeness", f"""SELECT f.file, strftime(f.file, '%Y-%m') AS year_month, s.site, coalesce(n, 0) AS valid_count,
    CAST(10 AS DOUBLE) AS cutoff, coalesce(n, 0) >= 10 AS valid, round_even(coalesce(CAST(n AS DOUBLE), 0) / 24 * 100, 2) AS valid_pct
    FROM (SELECT DISTINCT file FROM {b.HOURLY_SQL}) f, (SELECT unnest({b.SITES}) AS site) s
    LEFT JOIN (SELECT file, site, count(*) AS n FROM {b.HOURLY_SQL} GROUP BY ALL) c ON c.file = f.file AND c.site = s.site""")
def report_air_completeness(spark, sf):
    return air.file_completeness(b.hourly(spark, sf), "site", "ts", "file", b.SITES, HOURLY_CUTOFF, 24)


@query("report_air_validity", "SELECT year_month, " + ", ".join(
    f"max(CASE WHEN site = '{s}' THEN round_even(CAST(valid_count AS DOUBLE) / 31 * 100, 2) END) AS {s}" for s in b.SITES
) + f" FROM {COMPLETE_SQL} GROUP BY ALL")
def report_air_validity(spark, sf):
    gates = completeness(b.daily(spark, sf), "site", "year_month", b.SITES, 7.2, 31)
    return air.validity_table(gates, "year_month", "site")


@query("report_air_hourly", f"""SELECT 2024 AS year, local_time, round(avg(v), 6) AS value, round(hour(local_time::TIME) + minute(local_time::TIME) / 60
    + second(local_time::TIME) / 3600, 6) AS hour FROM (SELECT site, strftime(ts - INTERVAL 5 HOUR, '%H:%M:%S') AS local_time, avg(value) AS v
    FROM {b.HOURLY_SQL} GROUP BY ALL) GROUP BY ALL""")
def report_air_hourly(spark, sf):
    profile = air.hourly_profile(_hourly(spark, sf), "site", b.SITES, "year", "value")
    return profile.withColumns({"value": F.round("value", 6), "hour": F.round("hour", 6)})


@query("report_air_monthly", f"SELECT year, month, round(avg(value), 4) AS value FROM {GATED_SQL} WHERE n >= 7.2 GROUP BY ALL")
def report_air_monthly(spark, sf):
    return air.across_sites(gated(spark, sf, True), "year", "value").withColumn("value", F.round("value", 4))


@query("report_air_daily", f"""SELECT g.site, g.year, g.month, coalesce(n, 0) AS valid_count, CAST(3 AS DOUBLE) AS cutoff, coalesce(n, 0) >= 3 AS valid,
    round_even(coalesce(CAST(n AS DOUBLE), 0) / 31 * 100, 2) AS valid_pct, CASE WHEN n >= 3 THEN v END AS mean
    FROM (SELECT site, year, CAST(month AS INTEGER) AS month FROM (SELECT unnest({b.SITES}) AS site), (SELECT DISTINCT year FROM {b.DAILY_SQL}),
    (SELECT unnest(range(1, 13)) AS month)) g LEFT JOIN (SELECT site, year, month, count(*) AS n, avg(value) AS v FROM {b.DAILY_SQL}
    WHERE method IN ('1-URGENT', '2-HIGH') OR source = 'P' GROUP BY ALL) c ON g.site = c.site AND g.year = c.year AND g.month = c.month""")
def report_air_daily(spark, sf):
    chosen = air.daily_selection(b.daily(spark, sf), b.SITES, ["1-URGENT", "2-HIGH"], "P")
    return air.daily_by_month(chosen, "site", "date", "value", b.SITES, 3)


AIR_MONTHS = [(y, m) for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
AIR_ORDER = [*reversed(b.SITES), "s77"]


@query("report_air_sites", "SELECT o.site, " + ", ".join(
    f"max(CASE WHEN year = {y} AND month = {m} AND n >= 7.2 THEN value END) AS \"{m}/{y}\"" for y, m in AIR_MONTHS
) + f""", CAST(i AS INTEGER) AS position FROM (SELECT unnest({AIR_ORDER}) AS site, unnest(range({len(AIR_ORDER)})) AS i) o
    LEFT JOIN {GATED_SQL} g ON g.site = o.site GROUP BY ALL""")
def report_air_sites(spark, sf):
    return air.site_month_table(gated(spark, sf, False), "site", "year", "value", AIR_ORDER)


# --- response and traffic ------------------------------------------------------------------------------

RESPONSE_SQL = f"""SELECT year, month, area_type, init_severity, round(t, 4) AS average_travel_time, round(r, 4) AS average_response_time,
    round(d, 4) AS average_official_dispatch_time, round(g, 4) AS average_activation_seconds, n AS num_of_entries,
    round(r - t, 4) AS average_calculated_dispatch_time, round((r - t) / nullif(r, 0) * 100, 4) AS pct_calculated_dispatch,
    round(d / nullif(r, 0) * 100, 4) AS pct_official_dispatch FROM (
    SELECT CAST(year(incident_at) AS INTEGER) AS year, CAST(month(incident_at) AS INTEGER) AS month,
    CASE WHEN dispatch_area IN ('AO') THEN 'cbd' WHEN dispatch_area IN ('AF', 'NF') THEN 'bronx'
        WHEN dispatch_area IN ('NO', 'RO') THEN 'queens' END AS area_type,
    CASE WHEN severity_code IN ('1', '2', '3') THEN 'life_threat' ELSE 'non_life_threat' END AS init_severity,
    avg(nullif(travel_s, 0)) AS t, avg(nullif(response_s, 0)) AS r, avg(nullif(dispatch_s, 0)) AS d,
    avg(epoch(activated_at - assigned_at)) AS g, count(*) AS n FROM {b.INCIDENTS_SQL} GROUP BY ALL)"""


@query("report_response_times", RESPONSE_SQL)
def report_response_times(spark, sf):
    times = response.response_times(seconds(spark, sf), b.AREAS, b.LIFE_THREAT, list(range(1995, 2002)))
    means = [c for c in times.columns if c.startswith(("average", "pct"))]
    return times.withColumns({c: F.round(c, 4) for c in means})


@query("report_zero_times", f"""SELECT *, round(CAST(invalid_travel_time_count AS DOUBLE) / total_entries * 100, 6) AS invalid_travel_time_count_pct FROM (
    SELECT CAST(year(incident_at) AS INTEGER) AS year, CAST(sum(CASE WHEN travel_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_travel_time_count,
    CAST(sum(CASE WHEN response_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_response_time_count, count(*) AS total_entries
    FROM {b.INCIDENTS_SQL} GROUP BY ALL)""")
def report_zero_times(spark, sf):
    counted = response.zero_counts(seconds(spark, sf))
    return counted.withColumn("invalid_travel_time_count_pct", F.round("invalid_travel_time_count_pct", 6))


@query("report_traffic_daily", f"SELECT * FROM {DAILY_TOTAL_SQL}")
def report_traffic_daily(spark, sf):
    return traffic.daily_totals(hour_cells(spark, sf))


@query("report_traffic_rows", f"SELECT date, direction, hour, count, day_type, year, month, day FROM {USABLE_SQL}")
def report_traffic_rows(spark, sf):
    rows = traffic.classify_counts(b.counts(spark, sf), traffic.holiday_table(spark, b.TEST_HOLIDAYS))
    return traffic.usable(rows).drop("valid")


@query("report_traffic_hourly", side_by_side(
    f"(SELECT direction, day_type, hour, year, avg(count) AS v FROM {USABLE_SQL} GROUP BY ALL)", "direction, day_type, hour"))
def report_traffic_hourly(spark, sf):
    return rounded_years(traffic.hourly_comparison(hour_cells(spark, sf), PAIR))


@query("report_traffic_pages", """SELECT page_id, '2024-01-0' || d AS date, 'All' AS direction, lpad(CAST(h AS VARCHAR), 2, '0') || ':00:00' AS hour,
    CASE WHEN (page_id + h) % 5 > 0 THEN CAST(page_id * 10 + h * d AS DOUBLE) END AS count
    FROM pages, (SELECT unnest(range(3)) AS h), (SELECT unnest([1, 2]) AS d)""")
def report_traffic_pages(spark, sf):
    """Count tables built out of each page's id next to its own markup, then read back as pages."""
    def cells(tag, items):
        return F.concat(*[F.concat(F.lit(f"<{tag}>"), i, F.lit(f"</{tag}>")) for i in items])

    def row(tag, items):
        return F.concat(F.lit("<tr>"), cells(tag, items), F.lit("</tr>"))

    def counted(hour, day):
        value = (F.col("page_id") * 10 + hour * day).cast("string")
        return F.when((F.col("page_id") + hour) % 5 > 0, F.concat(F.lit("<b>"), value, F.lit("</b>"))).otherwise(F.lit("&nbsp;"))

    heads = [row("th", [F.lit(t) for t in texts]) for texts in (
        ("All directions",) * 4, ("", "Mon", "Tue", ""), ("Hour", "2024-01-01", "2024-01-02", "7 Day"))]
    hours = [row("td", [F.lit(f"{h:02d}:00:00"), counted(h, 1), counted(h, 2), F.lit("9")]) for h in range(3)]
    total = row("td", [F.lit("Total"), F.lit("1"), F.lit("2"), F.lit("3")])
    markup = F.concat(F.lit("<table><tr><td>small</td></tr></table>"), F.col("html"),
                      F.lit('<table class="counts">'), *heads, *hours, total, F.lit("</table>"))
    pages = table(spark, sf, "pages").select("page_id", markup.alias("html"))
    rows = traffic.counts_from_pages(pages)
    return rows.select("page_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "direction", "hour", "count")


