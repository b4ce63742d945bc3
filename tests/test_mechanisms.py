"""How the work is kept small: index sizes, copies, hot keys, one-pass pivots, key filters, changed days, changed inputs."""

import datetime
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from citylens.functions import rules
from citylens.operators import geo, joins, reshape, windows
from citylens.plans import places
from citylens.session import plan_bytes, scratch_path, stage_measured
from citylens.sinks import writers
from citylens.sources.schemas import Feed, schema
from citylens.streaming import ingest
from test_geo import SHAPES, edges_of, gap, inside, on_outline, points, regions

FEED = Feed(schema("ts timestamp, kind string, n int"), ("ts", "kind"), "ts")


def square(side, at=0.3):
    return {"box": [[[(at, at), (at + side, at), (at + side, at + side), (at, at + side)]]]}


# --- geometry


def test_index_grows_with_the_outline(spark):
    rows = {}
    for side in (50, 100, 200):
        index = geo.RegionIndex(regions(spark, square(side)), 1.0)
        rows[side] = index.inside.count() + index.outline.count()
        assert index.inside.agg(F.sum(F.expr("CAST(power(4, level) AS BIGINT)"))).first()[0] == (side - 1) ** 2  # every whole cell, once
    assert rows[100] < 2.3 * rows[50] and rows[200] < 2.3 * rows[100] and rows[200] < 200 * 200 / 10


def test_boxes_do_not_overlap_and_hold_no_outline(spark):
    index = geo.RegionIndex(regions(spark), 0.3)
    cells = {}
    for r in index.inside.collect():
        for x in range(r.kx << r.level, (r.kx + 1) << r.level):
            for y in range(r.ky << r.level, (r.ky + 1) << r.level):
                assert (r.region, x, y) not in cells
                cells[r.region, x, y] = True
                corner = ((x + 0.5) * 0.3, (y + 0.5) * 0.3)
                assert inside(corner, edges_of(SHAPES[r.region]))
    assert not {(r.region, r.cx, r.cy) for r in index.outline.collect()} & set(cells)


def test_asked_distances_match_brute_force(spark):
    rng = random.Random(5)
    asked = [(rng.uniform(-9, 25), rng.uniform(-9, 20), rng.choice(list(SHAPES))) for _ in range(300)]
    asked += [(4.0, 1.0, "ell"), (12.0, 3.0, "ring"), (13.0, 3.0, "ring"), (900.0, -300.0, "slant"), (6.0, 13.0, "pair")] * 2
    frame = spark.createDataFrame([*asked, (None, 1.0, "ell"), (float("nan"), 1.0, "ell"), (1.0, 1.0, "none")], "x double, y double, region string")
    for cell in (0.4, 3.0):
        found = {(r.x, r.y, r.region): r.distance for r in geo.region_distances(frame, geo.RegionIndex(regions(spark), cell)).collect()}
        assert set(found) == set(asked)
        for (x, y, name), distance in found.items():
            edges = edges_of(SHAPES[name])
            want = 0.0 if inside((x, y), edges) or on_outline((x, y), edges) else min(gap((x, y), e) for e in edges)
            assert math.isclose(distance, want, rel_tol=1e-12, abs_tol=1e-12)


def test_an_asked_pair_meets_few_edges(spark):
    # A circle of 2,000 edges: a pair must not meet them all.
    ring = [(100 * math.cos(2 * math.pi * k / 2000), 100 * math.sin(2 * math.pi * k / 2000)) for k in range(2000)]
    index = geo.RegionIndex(regions(spark, {"circle": [[ring]]}), 1.0)
    index.build()
    cells = index.place(points(spark, [(300, 40), (101, 3), (-500, -500)])).selectExpr("cx", "cy", "'circle' AS region")
    at_level = lambda level: index.boxes.where(f"level = {level}").drop("level")
    roots = cells.join(at_level(index.height).withColumn("level", F.lit(index.height)), "region")
    met = geo._candidates(roots, at_level, index, index.height, index.height + 1, ["cx", "cy", "region"])
    assert max(r["count"] for r in met.groupBy("cx", "cy").count().collect()) < 150


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(geo, "CELL_POINTS", 7)
    rng = random.Random(9)
    sample = points(spark, [(rng.uniform(3, 6), rng.uniform(0, 3)) for _ in range(200)])
    index = geo.RegionIndex(regions(spark), 2.0)
    found = {(r.x, r.y): r.region for r in geo.nearest_regions(sample, index, ties="first").collect()}
    for (x, y), name in found.items():
        distance = {n: 0.0 if inside((x, y), edges_of(p)) else min(gap((x, y), e) for e in edges_of(p)) for n, p in SHAPES.items()}
        assert math.isclose(distance[name], min(distance.values()), abs_tol=1e-12)
    assert len(found) == sample.count()


def test_no_regions_and_no_points(spark):
    none = geo.RegionIndex(regions(spark, square(1)).limit(0), 1.0)
    some = points(spark, [(1, 1), (2, 2)])
    assert geo.intersecting_regions(some, none).count() == 0 and geo.nearest_regions(some, none).count() == 0
    assert geo.nearest_regions(some.limit(0), geo.RegionIndex(regions(spark), 1.0)).count() == 0


# --- near points and hot keys


def test_labels_are_hardly_copied(spark):
    rng = random.Random(4)
    index = spark.createDataFrame([(rng.randrange(-10**6, 10**6), rng.randrange(-10**6, 10**6)) for _ in range(20_000)], "x long, y long")
    listed = index.select((F.size(joins._cells_near(F.col("x"))) * F.size(joins._cells_near(F.col("y")))).alias("n"))
    copies = listed.agg(F.avg("n")).first()[0]
    assert 1.0 <= copies < 1.1


@pytest.mark.parametrize("crowd", [1, 5, 256])
def test_near_points_in_crowded_cells(spark, crowd):
    rng = random.Random(crowd)
    spot = lambda: (rng.choice([0.0, 6.4e-4, -1.28e-3]) + rng.uniform(-2e-5, 2e-5), rng.uniform(-2e-4, 2e-4))
    left, right = [(i, *spot()) for i in range(300)], [(i, *spot()) for i in range(300)]
    a = spark.createDataFrame([*left, (900, None, 1.0)], "id int, x double, y double")
    b = spark.createDataFrame([*right, (901, 1.0, None)], "rid int, rx double, ry double")
    found = sorted((r.id, r.rid) for r in joins.within_distance(a, b, ("x", "y"), ("rx", "ry"), 1e-5, crowd).collect())
    want = sorted((i, j) for i, x, y in left for j, u, v in right if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= 1e-5)
    assert found == want and len(found) > 100


def test_only_hot_keys_are_salted(spark):
    big = spark.range(2000).select("id", F.when(F.col("id") < 1200, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert list(joins.hot_keys(big, ["k"], 100).values()) == [12]
    assert joins.hot_keys(big, ["k"], 5000) == {} and joins.hot_keys(big.limit(0), ["k"]) == {}
    small = spark.createDataFrame([("hot", 1), ("1500", 2), ("none", 3)], "k string, v int")
    plan = joins.salted_join(big, small, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "Generate" not in plan
    salted = joins.salted_join(big, small, ["k"], rows=100)
    assert salted.count() == 1201 and salted.columns == ["k", "id", "v"]


def test_hot_keys_of_other_types_and_missing_ones(spark):
    big = spark.range(900).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c"), (10**12, "d")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert joins.salted_join(big, small, ["k"], how, 50).count() == big.join(small, "k", how).count()
    keys = big.select(F.when(F.col("k") > 0, F.col("k")).alias("k"), "v")
    assert joins.salted_join(keys, small, ["k"], "left_semi", 50, null_safe=True).count() == 600
    assert joins.salted_join(keys, small, ["k"], "left_anti", 50, null_safe=True).count() == 300


# --- pivots


def test_a_pivot_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = spark.createDataFrame([(i % 4, f"x{i % 7}", float(i)) for i in range(100)], "i int, c string, v double")
    wide = reshape.pivot_mean(raw.mapInArrow(count, raw.schema), ["i"], "c", None, "v")
    assert wide.columns == ["i", *[f"x{k}" for k in range(7)]]
    wide.collect()
    assert seen.value == 100


def test_a_wide_pivot_has_no_limit_of_its_own(spark):
    long = spark.range(300).select((F.col("id") % 2).alias("i"), F.col("id").alias("c"), F.col("id").cast("string").alias("v"))
    spark.conf.set("spark.sql.pivotMaxValues", "50")
    try:
        assert len(reshape.pivot_once(long, ["i"], "c", None, "v").columns) == 301
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_pivots_of_dates_missing_values_and_nothing(spark):
    day = datetime.date
    rows = spark.createDataFrame([(1, day(2024, 2, 1), 1.0), (2, None, 2.0), (1, day(2023, 12, 1), None)], "i int, m date, v double")
    wide = reshape.pivot_once(rows, ["i"], "m", None, "v")
    assert wide.columns == ["i", "2023-12-01", "2024-02-01"]
    assert sorted(map(tuple, wide.collect()), key=str) == [(1, None, 1.0), (2, None, None)]
    assert reshape.pivot_mean(rows.limit(0), ["i"], "m", None, "v").columns == ["i"]
    years = spark.createDataFrame([("a", 2023, 4.0), ("a", 2024, 5.0)], "k string, y int, v double")
    assert [tuple(r) for r in windows.year_columns(years, ["k"], "y", "v", None).collect()] == [("a", 4.0, 5.0, 25.0)]
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_once(years.unionByName(years), ["k"], "y", None, "v").collect()


# --- ingest


def stamp(day, hour=0):
    return datetime.datetime(2024, 5, day, hour)


def feed_rows(spark, *rows):
    return spark.createDataFrame(list(rows), FEED.schema)


def keys(spark, path):
    return sorted(str((r.ts, r.kind)) for r in ingest.read_target(spark, path, FEED).collect())


def spoil(path, day):
    folder = f"{path}/{ingest.DAY}={day}"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            with open(f"{folder}/{name}", "wb") as file:
                file.write(b"no parquet")


def test_days_without_hits_are_not_read(spark, tmp_path):
    path = str(tmp_path / "target")
    ingest.insert_new(feed_rows(spark, (stamp(1), "a", 1), (stamp(2), "b", 2), (stamp(3), "c", 3)), path, FEED)
    kept = ingest.read_target(spark, path, FEED).where(F.col("ts") == F.lit(stamp(2))).count()
    assert kept == 1
    spoil(path, "2024-05-01")
    # day 1 cannot be read any more: rows that its filter does not know, and hits of other days, get in without it
    ingest.insert_new(feed_rows(spark, (stamp(1, 5), "z", 9), (stamp(2), "b", 2), (stamp(2), "new", 2), (stamp(4), "d", 4)), path, FEED)
    target = ingest.stored(spark, path, FEED)
    assert target.where(F.col(ingest.DAY) >= F.lit(datetime.date(2024, 5, 2))).count() == 4
    with pytest.raises(Exception):  # noqa: B017
        ingest.insert_new(feed_rows(spark, (stamp(1), "a", 1)), path, FEED)


def test_pages_with_keys_alone_are_hashed_and_not_sorted(spark, tmp_path, monkeypatch):
    plans, stage = [], ingest.stage
    monkeypatch.setattr(ingest, "stage", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or stage(rows, name))
    rows = feed_rows(spark, (stamp(1), "a", 1), (stamp(1), "a", 2), (stamp(2), None, 3), (stamp(2), None, 4))
    alone, whole = str(tmp_path / "alone"), str(tmp_path / "whole")
    ingest.insert_new(rows.drop(FEED.schema.names[2]), alone, FEED)
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]
    assert sorted(map(str, map(tuple, ingest.read_target(spark, alone, FEED).collect()))) == sorted(map(str, [(stamp(1), "a", None), (stamp(2), None, None)]))
    # a column that the batch has still chooses the row
    ingest.insert_new(rows, whole, FEED)
    assert sorted(r[2] for r in ingest.read_target(spark, whole, FEED).collect()) == [1, 3]


def test_many_runs_and_full_filters_add_nothing_twice(spark, tmp_path, monkeypatch):
    for name, value in (("FILTER_PARTS", 2), ("FILTER_BLOCKS", 1), ("FILTER_HASHES", 1)):
        monkeypatch.setattr(ingest, name, value)
    path, rng, all_rows = str(tmp_path / "target"), random.Random(1), []
    for _ in range(5):
        rows = [(stamp(rng.randint(1, 3), rng.randint(0, 20)), rng.choice(["a", "b", None, ""]), rng.randint(0, 9)) for _ in range(40)]
        rows += [(None, "timeless", 1)]
        all_rows += rows
        ingest.insert_new(feed_rows(spark, *rows, *rows[:7]), path, FEED)
        assert len(ingest._filter_parts(spark, path)) <= 3
    assert keys(spark, path) == sorted({str((ts, kind)) for ts, kind, _ in all_rows})


def test_a_target_from_before_filters(spark, tmp_path):
    path = str(tmp_path / "target")
    old = feed_rows(spark, (stamp(1), "a", 1), (None, "n", 2)).withColumn(ingest.DAY, F.to_date("ts"))
    old.write.partitionBy(ingest.DAY).parquet(path)
    ingest.insert_new(feed_rows(spark, (stamp(1), "a", 1), (None, "n", 2), (stamp(1), "b", 1)), path, FEED)
    assert len(keys(spark, path)) == 3


def test_a_filter_without_its_rows_does_no_harm(spark, tmp_path):
    path, rows = str(tmp_path / "target"), feed_rows(spark, (stamp(1), "a", 1), (stamp(2), "b", 1))
    ingest.remember_keys(rows, path, FEED)  # a run that broke off before its rows were written
    ingest.insert_new(rows, path, FEED)
    assert len(keys(spark, path)) == 2


def test_publish_writes_changed_days_only(spark, tmp_path):
    path, out = str(tmp_path / "target"), str(tmp_path / "out")
    ingest.insert_new(feed_rows(spark, (stamp(1), "a", 1), (stamp(2), "b", 2), (None, "n", 3)), path, FEED)
    ingest.publish(spark, path, FEED, out)
    listing = lambda: {d: sorted(os.listdir(f"{out}/{d}")) for d in os.listdir(out) if d.startswith(ingest.DAY)}
    before = listing()
    assert len(before) == 3
    ingest.insert_new(feed_rows(spark, (stamp(2), "c", 4), (stamp(3), "d", 5)), path, FEED)
    count, last = ingest.publish(spark, path, FEED, out, 1)
    after = listing()
    changed = {d for d in after if before.get(d) != after[d]}
    assert changed == {f"{ingest.DAY}=2024-05-02", f"{ingest.DAY}=2024-05-03"}
    assert count.first().row_count == 5 and last.first().kind == "d"
    assert spark.read.parquet(out).count() == 5
    ingest.publish(spark, path, FEED, out)
    assert listing() == after


def test_point_structures_become_text(spark):
    rows = spark.sql("SELECT named_struct('type', 'Point', 'coordinates', array(1.5D, 2D)) AS georeference UNION ALL SELECT NULL")
    assert sorted(str(r[0]) for r in ingest.with_point_text(rows).collect()) == ["None", "POINT (1.5 2.0)"]
    assert ingest.with_point_text(spark.range(1)).columns == ["id"]


# --- stages


def test_a_stage_notices_changed_input(spark, tmp_path):
    source, path, made = str(tmp_path / "in"), str(tmp_path / "stage"), []

    def build():
        made.append(1)
        return spark.read.parquet(source)

    once = lambda: writers.materialize_once(spark, path, build, inputs=[source, str(tmp_path / "none*")]).count()
    spark.range(3).write.parquet(source)
    assert (once(), once(), len(made)) == (3, 3, 1)
    spark.range(4).write.mode("append").parquet(source)
    assert (once(), once(), len(made)) == (7, 7, 2)
    (tmp_path / "none1").write_text("x")
    assert (once(), len(made)) == (7, 3)
    os.remove(f"{path}/_INPUTS")
    assert (once(), len(made)) == (7, 4)


def test_measures_of_a_stage(spark):
    staged, found = stage_measured(spark.range(10), "measured", most=F.max("id"), many=F.bool_or(F.col("id") > 8))
    assert staged.count() == 10 and found == {"most": 9, "many": True}
    assert stage_measured(spark.range(10).where("id < 0"), "measured", most=F.max("id"))[1] == {"most": None}
    assert plan_bytes(spark.range(1000)) == 8000


def test_severity_of_a_table(spark):
    rows = spark.createDataFrame([(" injured\v", "conscious", "Internal\t", "x"), ("Killed", None, None, None), (None,) * 4], "a string, b string, c string, d string")
    got = rules.with_severity(rows, "s", "a", "b", "c", "d")
    assert got.columns == ["a", "b", "c", "d", "s"] and [r.s for r in got.collect()] == ["A", "K", "U"]


def test_zones_of_neighbourhoods(spark):
    inner = places.CRZ_NEIGHBOURHOODS[0]
    rows = spark.createDataFrame(
        [(inner, "MN05 Midtown", "Manhattan"), ("Morningside Heights", "MN09 x", "Manhattan"), ("Harlem (North)", "MN10 x", "Manhattan"),
         ("Astoria (Central)", "QN01 x", "Queens"), ("Elsewhere", "BX01 x", "Bronx"), ("North Side", "QN01 x", "Brooklyn"), (None, None, None)],
        "region string, district string, borough string")
    flags = {r.name: (r.cbd, r.other_manhattan, r.outside_cbd) for r in places.neighbourhood_zones(rows).collect() if r.name}
    assert flags[inner] == (True, False, False) and flags["Harlem (North)"] == (False, True, True) and flags["Elsewhere"] == (False, False, True)
    areas = {r.region: r.area for r in places.area_groups(rows).collect()}
    assert areas == {inner: places.CRZ, "Harlem (North)": "Greater Harlem", "Astoria (Central)": "Astoria"}
