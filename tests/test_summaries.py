"""Aggregates, windows, reshaping and whole analyses."""

import datetime

import pytest
from pyspark.sql import functions as F

from citylens.operators import aggregates as agg
from citylens.operators import ordering, project, reshape, windows
from citylens.plans import air, crashes, places, response, traffic, trips
from citylens.session import parameter_table
from citylens.sources.schemas import schema


def test_group_sum_conventions(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("b", None)], "k string, v int")
    assert dict(rows(agg.group_sum(df, ["k"], {"s": "v"}), "k", "s")) == {None: 5, "a": 1, "b": None}
    assert dict(rows(agg.group_sum(df, ["k"], {"s": "v"}, keep_missing=False), "k", "s")) == {"a": 1, "b": 0}


def test_subtotals_overlap_and_add_up(spark):
    df = spark.createDataFrame([("x", "zone", 5), ("x", "near1", 2), ("x", "near2", 3), ("x", "Other", 7)], "k string, label string, n int")
    members = {"Near": ["near1", "near2"], "Zone": ["zone"], "Rest": ["Other"], "City": None}
    got = {r.label: r.n for r in agg.with_subtotals(df, ["k"], "label", "n", members, ["near1", "near2"]).collect()}
    assert got == {"near1": 2, "near2": 3, "Near": 5, "Zone": 5, "Rest": 7, "City": 17}
    assert got["Near"] + got["Zone"] + got["Rest"] == got["City"]


def test_grid_has_every_cell(spark):
    seen = spark.createDataFrame([(2020, 1, "a"), (2021, 2, "b")], "y int, m int, s string").withColumn("count", F.lit(3))
    grid = reshape.grid_fill(seen, seen, "y", {"m": [1, 2], "s": ["a", "b", "c"]})
    assert grid.count() == 2 * 2 * 3
    assert grid.agg(F.sum("count")).first()[0] == 6


def test_grid_axis_may_have_any_number_of_values(spark):
    seen = spark.range(150_000).select(F.col("id").alias("k"), F.lit("a").alias("s"), F.lit(1).alias("count"))
    grid = reshape.grid_fill(seen, seen, "k", {"s": ["a", "b"]})
    assert grid.agg(F.count("*"), F.sum("count")).first()[:] == (300_000, 150_000)
    assert "SinglePartition" not in grid._jdf.queryExecution().executedPlan().toString()


def test_grid_keeps_a_missing_axis_value(spark):
    seen = spark.createDataFrame([(None, "a", 2), (1, "b", 3)], "k int, s string, count int")
    assert reshape.grid_fill(seen, seen, "k", {"s": ["a", "b"]}).agg(F.count("*"), F.sum("count")).first()[:] == (4, 5)


def test_pivots_lose_no_value(spark):
    df = spark.createDataFrame([("a", "x10", 1.0), ("a", "x9", 2.0), ("b", "x1", 3.0)], "i string, c string, v double")
    assert reshape.pivot_once(df, ["i"], "c", None, "v").columns == ["i", "x1", "x9", "x10"]
    assert reshape.pivot_mean(df, ["i"], "c", None, "v").columns == ["i", "x1", "x9", "x10"]
    for pivot in (reshape.pivot_once, reshape.pivot_mean):
        with pytest.raises(Exception, match="without a column"):
            pivot(df, ["i"], "c", ["x1", "x9"], "v").collect()
    years = spark.createDataFrame([("d", 2023, 1.0), ("d", 2025, 5.0)], "d string, y int, v double")
    assert windows.year_columns(years, ["d"], "y", "v", None).columns == ["d", "2023", "2025", "yoy_2023_2025"]
    with pytest.raises(Exception, match="without a column"):
        windows.year_columns(years, ["d"], "y", "v", [2025]).collect()
    with pytest.raises(Exception, match="more than one row"):
        windows.year_columns(years.union(years), ["d"], "y", "v", None).collect()
    months = spark.sql("SELECT 'a' AS i, make_date(y, m, 1) AS m, 1 AS v FROM VALUES (2024, 2), (2023, 12), (2024, 1) AS t(y, m)")
    assert reshape.month_columns(months, ["i"], "m", None, "v").columns == ["i", "12/2023", "1/2024", "2/2024"]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "i string, c string, v int")
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_once(df, ["i"], "c", ["x"], "v").collect()


def test_reindex_fills_only_new_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("z", 9)], "k string, v int")
    got = [(r.k, r.v) for r in reshape.in_given_order(df, "k", ["c", "b", "a"], fill=0).orderBy("position").collect()]
    assert got == [("c", 0), ("b", None), ("a", 1)]


def test_change_percent_edge_cases(spark):
    df = spark.createDataFrame([("s", 1, 0), ("s", 2, 5), ("s", 3, 10), ("t", 1, 4), ("t", 2, None)], "s string, y int, v int")
    got = {(r.s, r.y): r.pct_change for r in windows.change_percent(df, ["s"], "y", "v").collect()}
    assert got == {("s", 1): None, ("s", 2): None, ("s", 3): 100.0, ("t", 1): None, ("t", 2): None}


def test_year_columns_round_half_even(spark):
    df = spark.createDataFrame([("n", 2024, 80000.0), ("n", 2025, 80100.0), ("z", 2024, 0.0), ("z", 2025, 1.0)], "d string, y int, v double")
    got = {r.d: r.yoy_2024_2025 for r in windows.year_columns(df, ["d"], "y", "v", [2024, 2025]).collect()}
    assert got == {"n": 0.12, "z": None}


def test_completeness_edges(spark):
    rows_ = [("a", "2024-01")] * 17 + [("a", "2024-02")] * 18 + [("x", "2024-02")] * 40
    df = spark.createDataFrame(rows_, "site string, period string")
    got = {(r.site, r.period): (r.valid_count, r.valid) for r in windows.completeness(df, "site", "period", ["a", "b"], 18, 31).collect()}
    assert got == {("a", "2024-01"): (17, False), ("a", "2024-02"): (18, True), ("b", "2024-01"): (0, False), ("b", "2024-02"): (0, False)}


def test_least_per_group_keeps_ties_and_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 2, 1), ("a", 2, 2), ("a", 3, 3), (None, 5, 4), ("b", None, 5)], "k string, v int, id int")
    assert [r[0] for r in rows(windows.least_per_group(df, ["k"], "v"), "id")] == [1, 2, 4]


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (None, "c", 1), (None, "d", 0)], "k int, v string, o int")
    got = sorted((str(r.k), r.v) for r in ordering.first_per_key(df, ["k"], ["o"]).collect())
    assert got == [("1", "a"), ("None", "d")]


def test_align_and_drop(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "b int, extra string, a double")
    out = project.align_to_schema(df, schema("a int, b string, c double"))
    assert out.columns == ["a", "b", "c"] and tuple(out.first()) == (2, "1", None)
    wide = spark.createDataFrame([(1, 2, 3, 4)], "`hour` int, `2024-01-01` int, `7 Day` int, `Count` int")
    assert project.drop_matching(wide, traffic.SUMMARY_COLUMNS).columns == ["hour", "2024-01-01"]


def test_injury_summary_adds_up(spark):
    data = [
        ("01/05/2024", "K", "Astoria"), ("01/06/2024", "K", places.CRZ), ("02/06/2024", "A", None), ("02/06/2024", "A", "Somewhere"),
        ("bad", "A", "Astoria"), ("03/01/2024", "U", "Astoria"), ("02/01/2023", "K", "Astoria"),
    ]
    df = spark.createDataFrame(data, "CRASH_DATE string, SEVERITY string, area string")
    counts = crashes.monthly_counts(df)
    assert counts.count() == 2 * 12 * 4 * (len(places.REPORTED_AREAS) + 1)
    out = crashes.summary(counts)
    totals = {(r.grouped, r.CRASH_YEAR, r.CRASH_MONTH, r.SEVERITY): r["count"] for r in out.collect()}
    assert totals[("City Total", 2024, 1, "K")] == 2 and totals[("CRZ Total", 2024, 1, "K")] == 1
    assert totals[("Other Total", 2024, 2, "A")] == 2 and totals[("Astoria", 2024, 2, "A")] == 0
    assert not any(k[0] == places.CRZ for k in totals)
    for (_, y, m, s), n in [(k, v) for k, v in totals.items() if k[0] == "City Total"]:
        assert n == sum(totals[(part, y, m, s)] for part in ("CRZ Adjacent Total", "CRZ Total", "Other Total"))


def test_distinct_crashes_count_once(spark):
    df = spark.createDataFrame([(1, "1/1/2024", "K"), (1, "1/1/2024", "K"), (2, "1/1/2024", "A")], "COLLISION_ID int, CRASH_DATE string, SEVERITY string")
    years = parameter_table(spark, "crash_year int", [(2023,), (2024,)])
    got = {r.crash_year: tuple(r[s] for s in crashes.SEVERITIES) for r in crashes.distinct_crashes(df, years).collect()}
    assert got == {2023: (0, 0, 0, 0), 2024: (1, 1, 0, 0)}


def test_area_groups(spark):
    data = [("West Village", "MN02 x", "Manhattan"), ("Harlem (North)", "MN10 x", "Manhattan"), ("Morningside Heights", "MN09 x", "Manhattan"),
            ("Rikers", "QN01 x", "Bronx"), ("Old Astoria", "QN01 x", "Queens"), ("East Williamsburg", "BK01 x", "Brooklyn")]
    groups = places.area_groups(spark.createDataFrame(data, "region string, district string, borough string"))
    assert {r.region: r.area for r in groups.collect()} == {
        "West Village": places.CRZ, "Harlem (North)": "Greater Harlem", "Old Astoria": "Astoria", "East Williamsburg": "Williamsburg",
    }


def test_board_names():
    names = dict(places.board_names())
    assert len(names) == 12 + 12 + 18 + 14 + 3 + 5
    assert names["cb_107"] == "Manhattan Community Board 7" and names["cb_503"] == "Staten Island Community Board 3" and names["cb_164"] == "Central Park"


def test_od_totals_and_dropped_trips(spark):
    square = lambda x: f"POLYGON (({x} 0, {x + 2} 0, {x + 2} 2, {x} 2, {x} 0))"
    regions = parameter_table(spark, "region string, wkt string", [("west", square(0)), ("east", square(6)), ("park", square(3))])
    data = [(1, 1.0, 1.0, 7.0, 1.0, 2.0), (2, 1.0, 1.0, 7.0, 1.0, 3.0), (3, 4.0, 1.0, 1.0, 1.0, 10.0), (4, None, 1.0, 1.0, 1.0, 99.0)]
    df = spark.createDataFrame(data, "id int, ox double, oy double, dx double, dy double, w double")
    flow = trips.od_flow(df, regions, weight="w", factor=2.0, out="r", exclude=["park"], cell=1.0)
    got = {(r.origin_region, r.destination_region): r.r for r in flow.collect()}
    # the park point lies 2 from either side, so its trip counts for both
    assert got == {("west", "east"): 10.0, ("east", "west"): 20.0, ("west", "west"): 20.0}
    first = trips.od_flow(df, regions, weight="w", factor=2.0, out="r", exclude=["park"], cell=1.0, ties="first")
    assert sum(r.r for r in first.collect()) == 2 * (2 + 3 + 10)


def test_near_duplicate_points_multiply_rows_only_where_fuzzy(spark):
    regions = parameter_table(spark, "region string, wkt string", [("a", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))")])
    data = [(1.0, 1.0, 5.0, 5.0), (1.0 + 5e-7, 1.0, 5.0, 5.0 + 5e-7)]
    df = spark.createDataFrame(data, "ox double, oy double, dx double, dy double")
    assert trips.od_flow(df, regions, exclude=[], cell=1.0).first().rides == 4
    assert trips.od_flow(df, regions, exclude=[], cell=1.0, origin_tolerance=None).first().rides == 2


def test_response_times(spark):
    data = [("M1", "1", "1,200", "0"), ("M2", "2", "0", "1,000"), ("ZZ", "7", "bad", None)]
    df = spark.createDataFrame(data, "dispatch_area string, severity_code string, t string, r string").withColumns({
        "incident_at": F.lit("2024-05-01").cast("timestamp"), "assigned_at": F.lit("2024-05-01 00:00:00").cast("timestamp"),
        "activated_at": F.lit("2024-05-01 00:00:00.5").cast("timestamp"), "d": F.lit("5"),
    })
    timed = response.with_seconds(df, {"travel_s": "t", "response_s": "r", "dispatch_s": "d"})
    got = {r.area_type: r for r in response.response_times(timed).collect()}
    assert got["cbd"].average_travel_time == 1200 and got["cbd"].average_response_time == 1000
    assert got["cbd"].average_activation_seconds == 0.5 and got["cbd"].init_severity == "life_threat"
    assert got[None].num_of_entries == 1 and got[None].average_travel_time is None and got[None].pct_official_dispatch is None


def test_air_months_from_file_and_local_time(spark):
    hourly = spark.createDataFrame(
        [("a", "2024-02-01T03:00:00", 4.0, "f1"), ("a", "2024-02-01T06:00:00", 8.0, "f1")], "site string, t string, v double, f string")
    local = air.localize(hourly, "t")
    assert sorted((r.month, r.local_time) for r in local.collect()) == [(1, "22:00:00"), (2, "01:00:00")]
    gates = air.file_completeness(hourly, "site", "t", "f", ["a", "b"], 2, 744)
    assert sorted((r.site, r.year_month, r.valid_count, r.valid) for r in gates.collect()) == [("a", "2024-02", 2, True), ("b", "2024-02", 0, False)]
    assert [tuple(r) for r in air.valid_months(gates, "site", "year_month").collect()] == [("a", 2024, 2)]


def test_daily_gate(spark):
    days = [datetime.date(2024, 1, d) for d in range(1, 19)] + [datetime.date(2024, 2, d) for d in range(1, 18)]
    df = spark.createDataFrame([("a", d, 2.0) for d in days], "site string, date date, v double")
    got = {(r.site, r.month): (r.valid_count, r.mean) for r in air.daily_by_month(df, "site", "date", "v", ["a", "b"]).collect()}
    assert len(got) == 24 and got[("a", 1)] == (18, 2.0) and got[("a", 2)] == (17, None) and got[("b", 3)] == (0, None)


def test_traffic_day_invalid_in_one_direction_is_left_out(spark):
    d1, d2 = datetime.date(2024, 3, 5), datetime.date(2024, 3, 6)
    data = [(d1, "All", "01:00:00", 5.0), (d1, "Northbound", "01:00:00", None), (d2, "All", "01:00:00", 7.0), (d2, "All", "02:00:00", 1.0)]
    rows_ = traffic.hour_cells(spark.createDataFrame(data, "date date, direction string, hour string, count double"), traffic.holiday_table(spark))
    assert [(r.day, r.direction, r["count"]) for r in traffic.daily_totals(rows_).collect()] == [(6, "All", 8.0)]
    wide = traffic.monthly_comparison(traffic.daily_totals(rows_), [2024, 2025])
    assert wide.columns == ["direction", "day_type", "month", "2024", "2025", "yoy_2024_2025"]
