"""Geometry against hand-made cases and a brute-force implementation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from citylens.operators import geo, joins
from citylens.session import parameter_table

SHAPES = {
    "ell": [[[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]]],
    "ring": [[[(10, 0), (16, 0), (16, 6), (10, 6)], [(12, 2), (14, 2), (14, 4), (12, 4)]]],
    "pair": [[[(0, 10), (2, 10), (2, 12), (0, 12)]], [[(5, 10), (7, 10), (6, 13)]]],
    "slant": [[[(4, 0), (9, 1), (4, 2)]]],
}


def wkt(parts):
    ring = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r + r[:1]) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(ring(r) for r in part) + ")" for part in parts) + ")"


def edges_of(parts):
    return [(a, b) for part in parts for r in part for a, b in zip(r, r[1:] + r[:1])]


def gap(p, e):
    (x1, y1), (x2, y2) = e
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((p[0] - x1) * dx + (p[1] - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - (x1 + t * dx), p[1] - (y1 + t * dy))


def on_outline(p, edges):
    return any(
        (x2 - x1) * (p[1] - y1) == (y2 - y1) * (p[0] - x1) and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2)
        for (x1, y1), (x2, y2) in edges
    )


def inside(p, edges):
    return sum((y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (x2 - x1) * (p[1] - y1) / (y2 - y1) for (x1, y1), (x2, y2) in edges) % 2 == 1


def regions(spark, shapes=SHAPES):
    return parameter_table(spark, "region string, wkt string", [(n, wkt(p)) for n, p in shapes.items()])


def points(spark, xs):
    return spark.createDataFrame([(float(x), float(y)) for x, y in xs], "x double, y double").distinct()


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(7)
    fixed = [(1, 1), (3, 3), (4, 1), (2, 3), (0, 0), (13, 3), (12, 3), (11, 1), (6, 11), (6, 13), (3, 11), (4, 0), (5, 1), (-500, 900)]
    fixed += [(900.0 + i / 7, -300.0 + i) for i in range(40)]  # a far cloud
    return fixed + [(rng.randrange(-16, 160) / 8, rng.randrange(-16, 120) / 8) for _ in range(400)] + [
        (rng.uniform(-3, 20), rng.uniform(-3, 15)) for _ in range(200)
    ]


@pytest.mark.parametrize("cell", [0.7, 1.0, 5.0])
def test_touching_and_within_match_brute_force(spark, sample, cell):
    index = geo.RegionIndex(regions(spark), cell)
    touching = {(r.x, r.y, r.region) for r in geo.intersecting_regions(points(spark, sample), index).collect()}
    within = {(r.x, r.y, r.region) for r in geo.within_regions(points(spark, sample), index).collect()}
    want_touch, want_in = set(), set()
    for p in {(float(x), float(y)) for x, y in sample}:
        for name, parts in SHAPES.items():
            edges = edges_of(parts)
            border = on_outline(p, edges)
            if border or inside(p, edges):
                want_touch.add((*p, name))
            if not border and inside(p, edges):
                want_in.add((*p, name))
    assert touching == want_touch
    assert within == want_in


@pytest.mark.parametrize("cell,levels", [(0.7, 16), (0.05, 6), (0.05, 16), (3.0, 2)])
def test_nearest_matches_brute_force(spark, sample, cell, levels):
    index = geo.RegionIndex(regions(spark), cell, levels)
    got = {}
    for r in geo.nearest_regions(points(spark, sample), index).collect():
        got.setdefault((r.x, r.y), {})[r.region] = r.distance
    assert set(got) == {(float(x), float(y)) for x, y in sample}
    for p, found in got.items():
        distance = {}
        for name, parts in SHAPES.items():
            edges = edges_of(parts)
            distance[name] = 0.0 if on_outline(p, edges) or inside(p, edges) else min(gap(p, e) for e in edges)
        least = min(distance.values())
        assert all(math.isclose(d, least, rel_tol=1e-12, abs_tol=1e-12) for d in found.values())
        near = {n for n, d in distance.items() if d == least}
        assert near <= set(found) or all(math.isclose(distance[n], least, rel_tol=1e-12) for n in found)


def test_equidistant_point_keeps_both_or_the_first(spark, rows):
    pair = {"b": [[[(0, 0), (1, 0), (1, 1), (0, 1)]]], "a": [[[(3, 0), (4, 0), (4, 1), (3, 1)]]]}
    index = geo.RegionIndex(regions(spark, pair), 1.0)
    middle = points(spark, [(2, 0.5)])
    assert rows(geo.nearest_regions(middle, index), "region", "distance") == [("a", 1.0), ("b", 1.0)]
    assert rows(geo.nearest_regions(middle, index, ties="first"), "region", "distance") == [("a", 1.0)]


def test_shared_edge_belongs_to_both_and_dissolves_once(spark, rows):
    halves = {"west": [[[(0, 0), (1, 0), (1, 1), (0, 1)]]], "east": [[[(1, 0), (2, 0), (2, 1), (1, 1)]]]}
    index = geo.RegionIndex(regions(spark, halves), 1.0)
    seam = points(spark, [(1, 0.5)])
    labels = geo.intersecting_regions(seam, index)
    assert rows(labels, "region") == [("east",), ("west",)]
    groups = parameter_table(spark, "region string, area string", [("east", "all"), ("west", "all")])
    assert rows(geo.dissolve(labels, groups), "region") == [("all",)]


def test_null_points_get_no_label(spark, rows):
    trips = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 0.5)], "id int, x double, y double")
    index = geo.RegionIndex(regions(spark), 1.0)
    labels = geo.nearest_regions(geo.distinct_points(trips, "x", "y"), index)
    assert rows(geo.label_points(trips, labels, ("x", "y"), "region", "left"), "id", "region") == [(1, "ell"), (2, None)]


def test_distances_of_named_pairs(spark):
    index = geo.RegionIndex(regions(spark), 1.0)
    pairs = spark.createDataFrame([(13.0, 3.0, "ring"), (11.0, 1.0, "ring"), (3.0, 3.0, "ell")], "x double, y double, region string")
    got = {(r.x, r.region): r.distance for r in geo.region_distances(pairs, index).collect()}
    assert got == {(13.0, "ring"): 1.0, (11.0, "ring"): 0.0, (3.0, "ell"): 1.0}


def test_within_distance_finds_every_near_pair_once(spark):
    rng = random.Random(3)
    left = [(i, rng.uniform(0, 1e-4), rng.uniform(-1e-4, 0)) for i in range(300)]
    right = [(i, rng.uniform(0, 1e-4), rng.uniform(-1e-4, 0)) for i in range(200)]
    eps = 1e-5
    a = spark.createDataFrame(left, "id int, x double, y double")
    b = spark.createDataFrame(right, "rid int, rx double, ry double")
    found = sorted((r.id, r.rid) for r in joins.within_distance(a, b, ("x", "y"), ("rx", "ry"), eps).collect())
    want = sorted((i, j) for i, x, y in left for j, u, v in right if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= eps)
    assert found == want and len(found) == len(set(found)) > 100


def test_point_text_forms(spark):
    df = spark.createDataFrame([("POINT (-73.5 40.25)", "(40.25, -73.5)"), (None, None), ("nothing", None)], "wkt string, pair string")
    got = df.select(geo.point_from_wkt("wkt").alias("p"), geo.point_from_latlon("pair").alias("q")).collect()
    assert tuple(got[0].p) == tuple(got[0].q) == (-73.5, 40.25)
    assert got[1].p is None and got[1].q is None and got[2].p is None


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 1).otherwise(F.col("id").cast("int")).alias("k"))
    small = spark.createDataFrame([(1, "a"), (1, "b"), (900, "c")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, "k", how)
        salted = joins.salted_join(big, small, ["k"], how, 5)
        assert sorted(map(str, plain.collect())) == sorted(map(str, salted.select(*plain.columns).collect()))
