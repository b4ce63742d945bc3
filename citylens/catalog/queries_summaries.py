"""Aggregates, time series and reshaping."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from citylens.catalog import bindings as b
from citylens.catalog.registry import query, table
from citylens.operators import aggregates as agg
from citylens.operators import reshape, windows
from citylens.plans import air, crashes, response, traffic
from citylens.session import parameter_table

YEARS = list(range(1995, 2002))
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

# --- grouped sums and counts -----------------------------------------------------------------------


@query("agg_sum_group", """SELECT nullif(l_returnflag, 'N') AS board, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price,
    CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL""")
def agg_sum_group(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("board", F.nullif("l_returnflag", F.lit("N")))
    sums = agg.group_sum(rows, ["board"], {"quantity": "l_quantity", "price": "l_extendedprice", "lines": "l_linenumber"})
    return sums.withColumn("price", F.round("price", 2))


@query("agg_count_group", "SELECT event_type, CAST(day(ts) AS INTEGER) AS day, count(*) AS rides FROM events GROUP BY ALL")
def agg_count_group(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("rides"))


@query("agg_size_keepnull", "SELECT \"EMOTIONAL_STATUS\" AS status, \"COMPLAINT\" AS complaint, count(*) AS count FROM " + b.PERSONS_SQL + " GROUP BY ALL")
def agg_size_keepnull(spark, sf):
    rows = b.persons(spark, sf).select(F.col("EMOTIONAL_STATUS").alias("status"), F.col("COMPLAINT").alias("complaint"))
    return agg.group_size(rows, ["status", "complaint"])


@query("agg_sum_dropnull", """SELECT direction, coalesce(sum(count), 0) AS count FROM (SELECT nullif(direction, 'N') AS direction,
    CASE WHEN direction <> 'R' THEN count END AS count FROM """ + b.COUNTS_SQL + ") WHERE direction IS NOT NULL GROUP BY ALL")
def agg_sum_dropnull(spark, sf):
    rows = b.counts(spark, sf).select(
        F.nullif("direction", F.lit("N")).alias("direction"), F.when(F.col("direction") != "R", F.col("count")).alias("count")
    )
    return agg.group_sum(rows, ["direction"], {"count": "count"}, keep_missing=False)


@query("agg_mean_group", "SELECT site, strftime(ts - INTERVAL 5 HOUR, '%H:00:00') AS hour, round(avg(value), 6) AS value FROM " + b.HOURLY_SQL + " GROUP BY ALL")
def agg_mean_group(spark, sf):
    rows = b.hourly(spark, sf).withColumn("hour", F.date_format(air.utc_to_local("ts"), "HH:00:00"))
    return agg.group_mean(rows, ["site", "hour"], "value").withColumn("value", F.round("value", 6))


@query("agg_mean_of_means", f"""SELECT month, round(avg(m), 4) AS value FROM (SELECT site, month, avg(value) AS m FROM {b.DAILY_SQL}
    GROUP BY ALL) GROUP BY ALL""")
def agg_mean_of_means(spark, sf):
    return agg.mean_of_means(b.daily(spark, sf), ["site"], ["month"], "value").withColumn("value", F.round("value", 4))


@query("agg_sum_then_mean", f"""SELECT direction, month, round(avg(s), 6) AS count FROM (SELECT direction, CAST(month(date) AS INTEGER) AS month,
    date, coalesce(sum(count), 0) AS s FROM {b.COUNTS_SQL} GROUP BY ALL) GROUP BY ALL""")
def agg_sum_then_mean(spark, sf):
    rows = b.counts(spark, sf).withColumn("month", F.month("date"))
    means = agg.sum_then_mean(rows, ["direction", "month", "date"], ["direction", "month"], "count")
    return means.withColumn("count", F.round("count", 6))


@query("agg_cond_sum", f"""SELECT CAST(year(incident_at) AS INTEGER) AS year,
    CAST(sum(CASE WHEN travel_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_travel_time_count,
    CAST(sum(CASE WHEN response_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_response_time_count, count(*) AS total_entries
    FROM {b.INCIDENTS_SQL} GROUP BY ALL""")
def agg_cond_sum(spark, sf):
    return response.zero_counts(seconds(spark, sf)).drop("invalid_travel_time_count_pct")


def seconds(spark, sf):
    texts = {"travel_s": "travel_text", "response_s": "response_text", "dispatch_s": "dispatch_text"}
    return response.with_seconds(b.incidents(spark, sf), texts)


@query("agg_cond_count", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
    count(CASE WHEN z IN (1, 2, 3) THEN 1 END) AS zone, count(CASE WHEN z NOT IN (1, 2, 3) THEN 1 END) AS other
    FROM (SELECT o_orderdate, nullif(c_nationkey, 5) AS z FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL""")
def agg_cond_count(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif("c_nationkey", F.lit(5)).alias("z"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate").join(customer, "o_custkey")
    inside = F.col("z").isin(1, 2, 3)
    return rows.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("zone"), F.count(F.when(~inside, 1)).alias("other")
    )


@query("agg_cond_avg", f"""SELECT dispatch_area, round(avg(CASE WHEN travel_s <> 0 THEN travel_s END), 6) AS travel,
    round(avg(CASE WHEN dispatch_s <> 0 THEN dispatch_s END), 6) AS dispatch FROM {b.INCIDENTS_SQL} GROUP BY ALL""")
def agg_cond_avg(spark, sf):
    return seconds(spark, sf).groupBy("dispatch_area").agg(
        F.round(agg.mean_nonzero("travel_s"), 6).alias("travel"), F.round(agg.mean_nonzero("dispatch_s"), 6).alias("dispatch")
    )


@query("agg_avg_interval", f"SELECT dispatch_area, round(avg(epoch(activated_at - assigned_at)), 4) AS seconds FROM {b.INCIDENTS_SQL} GROUP BY ALL")
def agg_avg_interval(spark, sf):
    gap = response.seconds_between("assigned_at", "activated_at")
    return b.incidents(spark, sf).groupBy("dispatch_area").agg(F.round(F.avg(gap), 4).alias("seconds"))


@query("agg_weighted_total", f"""SELECT event_type, round(sum(CAST(replace(weight_text, ',', '') AS DOUBLE)) * 4.348, 4) AS annual
    FROM {b.TRIPS_SQL} GROUP BY ALL""")
def agg_weighted_total(spark, sf):
    from citylens.functions.text import cast_commas
    from citylens.plans.trips import WEEKS_PER_MONTH

    total = F.sum(cast_commas("weight_text")) * WEEKS_PER_MONTH
    return b.trips(spark, sf).groupBy("event_type").agg(F.round(total, 4).alias("annual"))


@query("agg_count_distinct", "SELECT CAST(y AS INTEGER) AS crash_year, " + ", ".join(
    f"count(DISTINCT CASE WHEN o_orderpriority = '{p}' THEN o_custkey END) AS \"{p}\"" for p in PRIORITIES
) + " FROM (SELECT unnest(range(1994, 2003)) AS y) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY ALL")
def agg_count_distinct(spark, sf):
    rows = table(spark, sf, "orders").withColumn("crash_year", F.year("o_orderdate"))
    years = parameter_table(spark, "crash_year int", [(y,) for y in range(1994, 2003)])
    return agg.distinct_grid(rows, "crash_year", "o_orderpriority", "o_custkey", years, PRIORITIES)


ALL_VALID_SQL = "(SELECT date, bool_and(count IS NOT NULL) AS valid FROM " + b.COUNTS_SQL + " GROUP BY ALL)"


@query("agg_all_valid", f"SELECT date, valid FROM {ALL_VALID_SQL}")
def agg_all_valid(spark, sf):
    return windows.complete_groups(b.counts(spark, sf), ["date"], "count")


@query("join_map_back", f"SELECT c.date, c.direction, c.hour, v.valid FROM {b.COUNTS_SQL} c JOIN {ALL_VALID_SQL} v ON c.date = v.date")
def join_map_back(spark, sf):
    return windows.all_present(b.counts(spark, sf), ["date"], "count").select("date", "direction", "hour", "valid")


@query("agg_ratio_pct", f"""SELECT dispatch_area, round(t / nullif(n, 0) * 100, 6) AS pct FROM (SELECT dispatch_area, count(*) AS n,
    CAST(sum(CASE WHEN travel_s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS t FROM {b.INCIDENTS_SQL} GROUP BY ALL)""")
def agg_ratio_pct(spark, sf):
    counted = seconds(spark, sf).groupBy("dispatch_area").agg(
        agg.count_where(F.col("travel_s") == 0).alias("t"), F.count(F.lit(1)).alias("n")
    )
    return counted.select("dispatch_area", F.round(agg.percent(F.col("t"), F.col("n")), 6).alias("pct"))


GROUPED_SQL = f"""(SELECT CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, priority,
    CASE WHEN area IN ('n1', 'n2', 'n3') THEN area ELSE 'Other' END AS grouped, count(*) AS count
    FROM (SELECT o_orderdate AS d, o_orderpriority AS priority, 'n' || c_nationkey AS area
    FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL)"""
TOTAL_MEMBERS = {"Adjacent Total": ["n2", "n3"], "Zone Total": ["n1"], "Other Total": ["Other"], "City Total": None}


def grouped(spark, sf):
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, sf, "orders").join(customer, "o_custkey").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("area"),
    )
    label = crashes.keep_or(F.col("area"), ["n1", "n2", "n3"], "Other").alias("grouped")
    return agg.group_size(rows.select("y", "m", "priority", label), ["y", "m", "priority", "grouped"])


@query("agg_subtotals", f"""SELECT y, m, priority, tag AS grouped, CAST(sum(count) AS BIGINT) AS count FROM (
    SELECT *, grouped AS tag FROM {GROUPED_SQL} WHERE grouped IN ('n2', 'n3')
    UNION ALL SELECT *, 'Adjacent Total' FROM {GROUPED_SQL} WHERE grouped IN ('n2', 'n3')
    UNION ALL SELECT *, 'Zone Total' FROM {GROUPED_SQL} WHERE grouped = 'n1'
    UNION ALL SELECT *, 'Other Total' FROM {GROUPED_SQL} WHERE grouped = 'Other'
    UNION ALL SELECT *, 'City Total' FROM {GROUPED_SQL}) GROUP BY ALL""")
def agg_subtotals(spark, sf):
    return agg.with_subtotals(grouped(spark, sf), ["y", "m", "priority"], "grouped", "count", TOTAL_MEMBERS, ["n2", "n3"])


@query("agg_max", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events")
def agg_max(spark, sf):
    return table(spark, sf, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("agg_row_count", "SELECT count(*) AS row_count FROM lineitem")
def agg_row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("row_count"))


@query("agg_distinct", "SELECT DISTINCT site, year FROM " + b.DAILY_SQL)
def agg_distinct(spark, sf):
    return b.daily(spark, sf).select("site", "year").distinct()


# --- change over time -----------------------------------------------------------------------------------

YEARLY_SQL = "(SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL)"


def _lagged(lag, out, over):
    before = f"lag(n, {lag}) OVER (PARTITION BY priority ORDER BY {over})"
    return f"round(CAST(n - {before} AS DOUBLE) / nullif({before}, 0) * 100, 6) AS {out}"


@query("ts_pct_change", f"SELECT y, priority, n, {_lagged(1, 'change', 'y')} FROM {YEARLY_SQL}")
def ts_pct_change(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("priority"))
    changed = windows.change_percent(rows.agg(F.count("*").alias("n")), ["priority"], "y", "n", 1, "change")
    return changed.withColumn("change", F.round("change", 6))


MONTH_GRID_SQL = """(SELECT y, m, priority, coalesce(n, 0) AS n FROM (SELECT CAST(y AS INTEGER) AS y, CAST(m AS INTEGER) AS m, priority
    FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (SELECT unnest(range(1, 13)) AS m), (SELECT DISTINCT o_orderpriority AS priority FROM orders))
    LEFT JOIN (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS priority, count(*) AS n FROM orders
    GROUP BY ALL) USING (y, m, priority))"""


def month_grid(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("priority")
    )
    counts = agg.group_size(orders, ["y", "m", "priority"], "n")
    return reshape.grid_fill(counts, counts, "y", {"m": list(range(1, 13)), "priority": PRIORITIES}, "n")


@query("grid_fill", f"SELECT * FROM {MONTH_GRID_SQL}")
def grid_fill(spark, sf):
    return month_grid(spark, sf)


@query("ts_pct_change_12", f"SELECT y, m, priority, {_lagged(12, 'change', 'y, m')} FROM {MONTH_GRID_SQL}")
def ts_pct_change_12(spark, sf):
    dated = month_grid(spark, sf).withColumn("month", F.make_date("y", "m", F.lit(1)))
    changed = windows.change_percent(dated, ["priority"], "month", "n", 12, "change")
    return changed.select("y", "m", "priority", F.round("change", 6).alias("change"))


USABLE_SQL = f"""(SELECT c.*, {b.DAY_TYPE_SQL.format(d='c.date')} AS day_type, CAST(year(c.date) AS INTEGER) AS year,
    CAST(month(c.date) AS INTEGER) AS month, CAST(day(c.date) AS INTEGER) AS day
    FROM {b.COUNTS_SQL} c JOIN {ALL_VALID_SQL} v ON c.date = v.date
    WHERE v.valid AND {b.DAY_TYPE_SQL.format(d='c.date')} <> 'holiday')"""
DAILY_TOTAL_SQL = f"(SELECT year, month, day, direction, day_type, coalesce(sum(count), 0) AS count FROM {USABLE_SQL} GROUP BY ALL)"
PAIR = list(range(1995, 2002))


def side_by_side(source: str, index: str) -> str:
    cells = ", ".join(f"sum(CASE WHEN year = {y} THEN v END) AS \"{y}\"" for y in PAIR)
    changes = ", ".join(
        f"round_even((\"{n}\" - \"{o}\") / nullif(\"{o}\", 0) * 100, 2) AS yoy_{o}_{n}" for o, n in zip(PAIR, PAIR[1:])
    )
    shown = ", ".join(f"round(\"{y}\", 6) AS \"{y}\"" for y in PAIR)
    return f"SELECT {index}, {shown}, {changes} FROM (SELECT {index}, {cells} FROM {source} GROUP BY ALL)"


def hour_cells(spark, sf):
    return traffic.hour_cells(b.counts(spark, sf), traffic.holiday_table(spark, b.TEST_HOLIDAYS))


def rounded_years(df):
    return df.withColumns({str(y): F.round(F.col(f"`{y}`"), 6) for y in PAIR})


@query("ts_yoy_columns", side_by_side(
    f"(SELECT direction, day_type, month, year, avg(count) AS v FROM {DAILY_TOTAL_SQL} GROUP BY ALL)", "direction, day_type, month"))
def ts_yoy_columns(spark, sf):
    return rounded_years(traffic.monthly_comparison(traffic.daily_totals(hour_cells(spark, sf)), PAIR))


COMPLETE_SQL = f"""(SELECT year_month, site, coalesce(n, 0) AS valid_count FROM
    (SELECT * FROM (SELECT DISTINCT year_month FROM {b.DAILY_SQL}), (SELECT unnest({b.SITES}) AS site))
    LEFT JOIN (SELECT year_month, site, count(*) AS n FROM {b.DAILY_SQL} GROUP BY ALL) USING (year_month, site))"""


@query("ts_completeness", f"""SELECT year_month, site, valid_count, CAST(7.2 AS DOUBLE) AS cutoff, valid_count >= 7.2 AS valid,
    round_even(CAST(valid_count AS DOUBLE) / 31 * 100, 2) AS valid_pct FROM {COMPLETE_SQL}""")
def ts_completeness(spark, sf):
    return windows.completeness(b.daily(spark, sf), "site", "year_month", b.SITES, 7.2, 31)


GATED_SQL = f"""(SELECT site, year, month, year_month, avg(value) AS value, count(*) AS n FROM {b.DAILY_SQL} GROUP BY ALL)"""


def gated(spark, sf, drop):
    gates = air.valid_months(windows.completeness(b.daily(spark, sf), "site", "year_month", b.SITES, 7.2, 31), "site", "year_month")
    return air.monthly_by_site(b.daily(spark, sf), gates, "site", "year", "value", drop)


@query("ts_gated_mean", f"SELECT site, year, month, CASE WHEN n >= 7.2 THEN value END AS value FROM {GATED_SQL}")
def ts_gated_mean(spark, sf):
    return gated(spark, sf, False)


# --- reshaping --------------------------------------------------------------------------------------------

@query("pivot_wide", "SELECT y, " + ", ".join(f"max(CASE WHEN priority = '{p}' THEN n END) AS \"{p}\"" for p in PRIORITIES)
       + f" FROM {YEARLY_SQL} GROUP BY ALL")
def pivot_wide(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("priority"))
    return reshape.pivot_once(rows.agg(F.count("*").alias("n")), ["y"], "priority", None, "n")


SHOWN_SITES = [f"s{i:02d}" for i in range(26)]


@query("pivot_agg", "SELECT year_month, " + ", ".join(
    f"coalesce(avg(CASE WHEN site = '{s}' THEN value END), 0) AS {s}" for s in SHOWN_SITES) + f" FROM {b.DAILY_SQL} GROUP BY ALL")
def pivot_agg(spark, sf):
    return reshape.pivot_mean(b.daily(spark, sf), ["year_month"], "site", None, "value")


SITE_ORDER = ["s05", "s99", "s03", "s98"]


@query("reindex_order", f"""SELECT site, CASE WHEN n IS NULL THEN 0 ELSE nullif(n, (SELECT n FROM (SELECT count(*) AS n FROM {b.DAILY_SQL}
    WHERE site = 's03'))) END AS n, CAST(i AS INTEGER) AS position FROM (SELECT unnest({SITE_ORDER}) AS site, unnest(range(4)) AS i)
    LEFT JOIN (SELECT site, count(*) AS n FROM {b.DAILY_SQL} GROUP BY ALL) USING (site)""")
def reindex_order(spark, sf):
    sizes = agg.group_size(b.daily(spark, sf), ["site"], "n").withColumn("n", F.when(F.col("site") != "s03", F.col("n")))
    return reshape.in_given_order(sizes, "site", SITE_ORDER, fill=0).orderBy("position")


MONTHS = [datetime.date(y, m, 1) for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]


@query("cols_chronological", "SELECT site, " + ", ".join(
    f"avg(CASE WHEN year = {d.year} AND month = {d.month} THEN value END) AS \"{d.month}/{d.year}\"" for d in sorted(MONTHS)
) + f" FROM {b.DAILY_SQL} GROUP BY ALL")
def cols_chronological(spark, sf):
    means = agg.group_mean(b.daily(spark, sf), ["site", "year", "month"], "value")
    dated = means.select("site", F.make_date("year", "month", F.lit(1)).alias("month"), "value")
    return reshape.month_columns(dated, ["site"], "month", None, "value")
