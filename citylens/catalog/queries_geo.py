"""Points, regions, distances and geometric joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from citylens.catalog import bindings as b
from citylens.catalog.registry import query, table
from citylens.operators import geo, joins
from citylens.operators.windows import least_per_group
from citylens.plans.trips import od_flow
from citylens.session import parameter_table

BOX_IN = "x > x0 AND x < x1 AND y > y0 AND y < y1"
BOX_ON = "x >= x0 AND x <= x1 AND y >= y0 AND y <= y1"
ORIGINS_SQL = f"(SELECT DISTINCT ox AS x, oy AS y FROM {b.TRIPS_SQL} t)"


def origins(spark, sf):
    return geo.distinct_points(b.trips(spark, sf), "ox", "oy")


def index(spark):
    return geo.RegionIndex(b.rectangles(spark), b.CELL)


@query("geo_distance", f"""SELECT DISTINCT x, y, region, round({b.GAP_SQL}, 9) AS distance
    FROM (SELECT ox AS x, oy AS y, 'r' || (event_id % 4 + 1) AS asked FROM {b.TRIPS_SQL} t), {b.RECTANGLES_SQL} WHERE asked = region""")
def geo_distance(spark, sf):
    asked = F.concat(F.lit("r"), (F.col("event_id") % 4 + 1).cast("string")).alias("region")
    pairs = b.trips(spark, sf).select(F.col("ox").alias("x"), F.col("oy").alias("y"), asked)
    return geo.region_distances(pairs, index(spark)).withColumn("distance", F.round("distance", 9))


@query("geo_nearest", f"""SELECT x, y, region, round(gap, 9) AS distance FROM (SELECT x, y, region, {b.GAP_SQL} AS gap
    FROM {ORIGINS_SQL} o, {b.RECTANGLES_SQL}) QUALIFY gap = min(gap) OVER (PARTITION BY x, y)""")
def geo_nearest(spark, sf):
    labels = geo.nearest_regions(origins(spark, sf), index(spark))
    return labels.withColumn("distance", F.round("distance", 9))


@query("geo_region_exclude", f"""SELECT x, y, region FROM (SELECT x, y, region, {b.GAP_SQL} AS gap
    FROM {ORIGINS_SQL} o, {b.RECTANGLES_SQL} WHERE region NOT IN ('r2')) QUALIFY gap = min(gap) OVER (PARTITION BY x, y)""")
def geo_region_exclude(spark, sf):
    kept = geo.RegionIndex(geo.drop_regions(b.rectangles(spark), ["r2"]), b.CELL)
    return geo.nearest_regions(origins(spark, sf), kept).drop("distance")


@query("join_point_within", f"""SELECT event_id, region FROM (SELECT event_id, ox AS x, oy AS y FROM {b.TRIPS_SQL} t), {b.RECTANGLES_SQL}
    WHERE {BOX_IN}""")
def join_point_within(spark, sf):
    labels = geo.within_regions(origins(spark, sf), index(spark))
    return geo.label_points(b.trips(spark, sf), labels, ("ox", "oy"), "region", "inner").select("event_id", "region")


@query("join_point_intersects", f"""SELECT event_id, region FROM (SELECT event_id, ox AS x, oy AS y FROM {b.TRIPS_SQL} t)
    LEFT JOIN {b.RECTANGLES_SQL} ON {BOX_ON}""")
def join_point_intersects(spark, sf):
    labels = geo.intersecting_regions(origins(spark, sf), index(spark))
    return geo.label_points(b.trips(spark, sf), labels, ("ox", "oy"), "region", "left").select("event_id", "region")


# An L, a square with a hole and a triangle with a slanted edge.
SHAPES = [
    ("ell", "POLYGON ((0 0, 6 0, 6 3, 3 3, 3 6, 0 6, 0 0))"), ("ring", "POLYGON ((7 0, 13 0, 13 6, 7 6, 7 0), (9 2, 11 2, 11 4, 9 4, 9 2))"),
    ("slant", "MULTIPOLYGON (((0 8, 6 8, 0 13, 0 8)))"),
]
SHAPES_SQL = """(SELECT x, y, region, inside FROM (SELECT DISTINCT ox AS x, oy AS y FROM {trips} t), LATERAL (
    SELECT 'ell' AS region, x >= 0 AND y >= 0 AND x <= 6 AND y <= 6 AND (x <= 3 OR y <= 3) AS touching, x > 0 AND y > 0 AND x < 6 AND y < 6 AND (x < 3 OR y < 3) AS inside
    UNION ALL SELECT 'ring', x BETWEEN 7 AND 13 AND y BETWEEN 0 AND 6 AND NOT (x > 9 AND x < 11 AND y > 2 AND y < 4),
        x > 7 AND x < 13 AND y > 0 AND y < 6 AND NOT (x BETWEEN 9 AND 11 AND y BETWEEN 2 AND 4)
    UNION ALL SELECT 'slant', x >= 0 AND y >= 8 AND 5 * x + 6 * (y - 8) <= 30, x > 0 AND y > 8 AND 5 * x + 6 * (y - 8) < 30) s WHERE touching)"""


@query("join_point_shapes", f"SELECT x, y, region, inside FROM {SHAPES_SQL.format(trips=b.TRIPS_SQL)}")
def join_point_shapes(spark, sf):
    """Points in or on regions of any outline, and whether they lie strictly inside."""
    shapes = geo.RegionIndex(parameter_table(spark, "region string, wkt string", SHAPES), 0.4)
    return geo.touching_regions(origins(spark, sf), shapes).select("x", "y", "region", (~F.col("on_edge")).alias("inside"))


@query("update_from_join", f"""SELECT event_id, min(region) AS region FROM (SELECT event_id, ox AS x, oy AS y FROM {b.TRIPS_SQL} t)
    LEFT JOIN {b.RECTANGLES_SQL} ON {BOX_ON} GROUP BY ALL""")
def update_from_join(spark, sf):
    labels = geo.intersecting_regions(origins(spark, sf), index(spark))
    return geo.label_points(b.trips(spark, sf), labels, ("ox", "oy"), "region", "left", "min").select("event_id", "region")


GROUPS = [("r1", "A"), ("r2", "A"), ("r3", "B")]
AREA = "CASE WHEN region IN ('r1', 'r2') THEN 'A' WHEN region = 'r3' THEN 'B' ELSE region END"


def groups(spark):
    return parameter_table(spark, "region string, area string", GROUPS)


@query("geo_dissolve", f"SELECT DISTINCT x, y, {AREA} AS region FROM {ORIGINS_SQL} o, {b.RECTANGLES_SQL} WHERE {BOX_ON}")
def geo_dissolve(spark, sf):
    return geo.dissolve(geo.intersecting_regions(origins(spark, sf), index(spark)), groups(spark))


@query("geo_enrich", f"""SELECT DISTINCT event_id, event_type, {AREA} AS area FROM (SELECT event_id, event_type, ox AS x, oy AS y
    FROM {b.TRIPS_SQL} t) LEFT JOIN {b.RECTANGLES_SQL} ON {BOX_ON}""")
def geo_enrich(spark, sf):
    labels = geo.dissolve(geo.intersecting_regions(origins(spark, sf), index(spark)), groups(spark))
    rows = geo.label_points(b.trips(spark, sf), labels, ("ox", "oy"), "area", "left")
    return rows.select("event_id", "event_type", "area")


@query("join_geom_equal", f"""SELECT event_id, region FROM {b.TRIPS_SQL} t JOIN {b.nearest_sql("ox", "oy")} n ON t.ox = n.x AND t.oy = n.y""")
def join_geom_equal(spark, sf):
    labels = geo.nearest_regions(origins(spark, sf), index(spark))
    return geo.label_points(b.trips(spark, sf), labels, ("ox", "oy"), "region", "inner").select("event_id", "region")


@query("join_dwithin", f"""SELECT event_id, region FROM (SELECT event_id, ox + (event_id % 3) * 4e-7 AS px, oy AS py FROM {b.TRIPS_SQL} t)
    JOIN {b.nearest_sql("ox", "oy")} n ON sqrt((px - n.x) ** 2 + (py - n.y) ** 2) <= 1e-6""")
def join_dwithin(spark, sf):
    shifted = b.trips(spark, sf).select("event_id", (F.col("ox") + (F.col("event_id") % 3) * 4e-7).alias("px"), F.col("oy").alias("py"))
    labels = geo.nearest_regions(origins(spark, sf), index(spark))
    return joins.within_distance(shifted, labels, ("px", "py"), ("x", "y"), 1e-6).select("event_id", "region")


@query("join_cross", f"""SELECT x, y, region FROM {ORIGINS_SQL} o, {b.RECTANGLES_SQL}
    WHERE floor(x) BETWEEN x0 - 1 AND x1 AND floor(y) BETWEEN y0 - 1 AND y1""")
def join_cross(spark, sf):
    """The pairs a points x regions product would be searched for, found by grid cell instead."""
    return geo.cell_candidates(origins(spark, sf), index(spark))


@query("win_min_qualify", """SELECT o_custkey, o_orderkey, price FROM (SELECT o_custkey, o_orderkey,
    CASE WHEN o_orderkey % 10 > 0 THEN floor(o_totalprice / 50000) END AS price FROM orders) WHERE price IS NOT NULL
    QUALIFY price = min(price) OVER (PARTITION BY o_custkey)""")
def win_min_qualify(spark, sf):
    step = F.floor(F.col("o_totalprice") / 50000).cast("double")
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, step).alias("price"))
    return least_per_group(rows, ["o_custkey"], "price")


@query("agg_od_matrix", f"""SELECT o.region AS origin_region, d.region AS destination_region, count(*) AS rides FROM {b.TRIPS_SQL} t
    JOIN {b.nearest_sql("ox", "oy")} o ON t.ox = o.x AND t.oy = o.y JOIN {b.nearest_sql("dx", "dy")} d ON t.dx = d.x AND t.dy = d.y GROUP BY ALL""")
def agg_od_matrix(spark, sf):
    return od_flow(b.trips(spark, sf), b.rectangles(spark), exclude=[], cell=b.CELL)
