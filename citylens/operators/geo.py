"""Planar geometry on plain columns.

Points are two doubles (x = longitude, y = latitude, never projected).  Regions are rows of WKT text
that become an edge table; every test is a column expression over edges.

How the work is kept small:

* all tests run on distinct points, whose answers are joined back by coordinates;
* a region becomes a quadtree: grid cells its outline passes through, and the largest cells, of any level, that
  lie wholly inside.  The number of both grows with the outline, not with the area.  Points in inside cells are
  answered by that join; only points in outline cells meet edges, and of those only the edges in the same grid row;
* distances are needed only for points outside every region.  Cells look for an edge around them level by level,
  from fine to coarse; only cells without one go on.  The boxes found are opened again towards the finest level
  and thinned by distance bounds at every step, so a point meets few edges however far it lies.  The
  coarsest level is one cell for the whole plane, so far points are answered exactly too;
* distances to a named region descend its own quadtree in the same way.

Every join here is an equi-join on cells or coordinates: there is no points x regions product.  Cells crowded
with points are split by their counted size.
Region cells, distinct points and their first answers are written to the shared folder and read
back.  That keeps plans short, survives lost executors, and tells the planner the true size of each
side before it chooses to broadcast it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.functions.text import _c
from citylens.operators.joins import salted_join
from citylens.session import stage, stage_measured, together

CELL = 0.002  # default grid width in degrees, about 200 m: a few outline edges per cell
CELL_POINTS = 20_000  # a cell with more points is handled in several parts
OPENED = 4  # levels by which boxes are opened at a time
LEVELS = 18  # each level doubles the width; the last one is a single cell for the whole plane


# --- points ---------------------------------------------------------------------------------

def with_point(df: DataFrame, lon: str, lat: str, x: str = "x", y: str = "y") -> DataFrame:
    """Add point columns; both are NULL when either coordinate is missing or not a number."""
    whole = F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(F.col(lon).cast("double")) & ~F.isnan(F.col(lat).cast("double"))
    return df.withColumns({
        x: F.when(whole, F.col(lon).cast("double")),
        y: F.when(whole, F.col(lat).cast("double")),
    })


def point_from_wkt(value: Column | str) -> Column:
    """``POINT (x y)`` text to a struct of two doubles, NULL for anything else."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$"
    x = F.regexp_extract(_c(value), pattern, 1)
    y = F.regexp_extract(_c(value), pattern, 2)
    return F.when(x != "", F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def point_from_latlon(value: Column | str) -> Column:
    """``"(lat, lon)"`` text to a struct x = lon, y = lat."""
    part = F.split(F.translate(_c(value), "()", ""), ",")
    lat, lon = F.trim(F.get(part, 0)).cast("double"), F.trim(F.get(part, 1)).cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lon.alias("x"), lat.alias("y")))


def geojson_point_wkt(geometry: Column | str) -> Column:
    """``{type, coordinates: [lon, lat]}`` to ``POINT (lon lat)`` text, NULL when absent."""
    pair = _c(geometry).getField("coordinates")
    text = F.concat(F.lit("POINT ("), F.get(pair, 0).cast("string"), F.lit(" "), F.get(pair, 1).cast("string"), F.lit(")"))
    return F.when(F.size(pair) == 2, text)


# --- regions --------------------------------------------------------------------------------
# Longer expressions below are SQL text: one call to the JVM instead of one per operator.

def polygon_edges(regions: DataFrame, region: str = "region", wkt: str = "wkt") -> DataFrame:
    """(Multi)polygon WKT to edges ``(region, ring, x1, y1, x2, y2)``; holes are rings too."""
    rings = regions.selectExpr(
        f"`{region}` AS region", f"posexplode(regexp_extract_all(`{wkt}`, '[(]([^()]+)[)]', 1)) AS (ring, body)"
    )
    vertices = rings.selectExpr("region", "ring", "transform(split(body, ','), p -> split(trim(p), '[ \t\r\n]+')) AS v")
    edges = vertices.where("size(v) > 1").selectExpr(
        "region", "ring",
        """explode(transform(slice(v, 1, size(v) - 1), (p, i) -> struct(
            CAST(p[0] AS DOUBLE) AS x1, CAST(p[1] AS DOUBLE) AS y1,
            CAST(v[i + 1][0] AS DOUBLE) AS x2, CAST(v[i + 1][1] AS DOUBLE) AS y2))) AS e""",
    )
    return edges.select("region", "ring", "e.*").where("x1 != x2 OR y1 != y2")


def drop_regions(regions: DataFrame, names: list[str], region: str = "region") -> DataFrame:
    """Leave out named regions; a region without a name is left out as well."""
    return regions.where(~F.col(region).isin(names)) if names else regions.where(F.col(region).isNotNull())


def _steps(lo: str, hi: str, cell: float) -> str:
    return f"explode(sequence(floor(({lo}) / {cell!r}D), floor(({hi}) / {cell!r}D)))"


def edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge with every grid cell it passes through (a hair's breadth around it included).

    The edge is walked along its longer axis one grid line at a time, so the number of rows grows
    with its length, not with the area of its bounding box.
    """
    cell = float(cell)
    pad = f"{cell * 1e-6!r}D"
    walked = edges.selectExpr("*", "abs(x2 - x1) >= abs(y2 - y1) AS flat").selectExpr(
        "*", "IF(flat, x1, y1) AS u1", "IF(flat, y1, x1) AS v1", "IF(flat, x2, y2) AS u2", "IF(flat, y2, x2) AS v2"
    ).selectExpr("*", _steps("least(u1, u2)", "greatest(u1, u2)", cell) + " AS cu")
    at = "v1 + ({} - u1) * ((v2 - v1) / (u2 - u1))"
    ends = walked.selectExpr(
        "*",
        at.format(f"greatest(least(u1, u2), cu * {cell!r}D - {pad})") + " AS va",
        at.format(f"least(greatest(u1, u2), (cu + 1) * {cell!r}D + {pad})") + " AS vb",
    )
    cells = ends.selectExpr("*", _steps(f"least(va, vb) - {pad}", f"greatest(va, vb) + {pad}", cell) + " AS cv")
    return cells.selectExpr(*edges.columns, "IF(flat, cu, cv) AS cx", "IF(flat, cv, cu) AS cy")


def edge_rows(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge once per grid row its height covers."""
    return edges.selectExpr("*", _steps("least(y1, y2)", "greatest(y1, y2)", float(cell)) + " AS cy")


# how many of the grouped edges a ray from the point towards +x crosses
_CROSSINGS = """count_if((y1 > {y}) != (y2 > {y})
    AND {x} < x1 + (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0D))"""
# whether any of the grouped edges passes through the point
_TOUCHES = """coalesce(bool_or((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0
    AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2) AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2)), false)"""
# how far along the edge, from 0 to 1, its point nearest to (x, y) lies
_ALONG = """greatest(0D, least(1D, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1))
    / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"""


def _crossings(x: str, y: str) -> Column:
    return F.expr(_CROSSINGS.format(x=x, y=y))


def _least_gap() -> Column:
    """Distance from point (x, y) to the nearest of the grouped edges."""
    dx, dy = f"(x - (x1 + {_ALONG} * (x2 - x1)))", f"(y - (y1 + {_ALONG} * (y2 - y1)))"
    return F.expr(f"min(sqrt({dx} * {dx} + {dy} * {dy}))")


def outline_boxes(outline: DataFrame, height: int) -> DataFrame:
    """Boxes ``(region, level, kx, ky)`` that hold part of a region's outline, on levels 0 to ``height``."""
    up = outline.selectExpr("region", "cx", "cy", f"explode(sequence(0, {height})) AS level")
    return up.selectExpr("region", "level", "shiftright(cx, level) AS kx", "shiftright(cy, level) AS ky").distinct()


def inside_boxes(boxes: DataFrame, rows: DataFrame, cell: float) -> DataFrame:
    """Largest boxes ``(region, level, kx, ky)`` that lie wholly inside their region.

    They are the quarters of boxes with outline that have none themselves: all of such a quarter has one
    answer, found by testing the centre of its first cell.  There are at most three to a box with outline.
    """
    quarters = boxes.where("level > 0").selectExpr(
        "region", "CAST(level - 1 AS INT) AS level", "explode(array(2 * kx, 2 * kx + 1)) AS kx", "ky"
    ).selectExpr("region", "level", "kx", "explode(array(2 * ky, 2 * ky + 1)) AS ky")
    blank = quarters.join(boxes, ["region", "level", "kx", "ky"], "left_anti")
    centres = blank.selectExpr(
        "*", "shiftleft(ky, level) AS cy", f"(shiftleft(kx, level) + 0.5D) * {cell!r}D AS px", f"(shiftleft(ky, level) + 0.5D) * {cell!r}D AS py"
    )
    tested = centres.join(rows, ["region", "cy"]).groupBy("region", "level", "kx", "ky").agg(_crossings("px", "py").alias("n"))
    return tested.where("n % 2 = 1").select("region", "level", "kx", "ky")


class RegionIndex:
    """Regions prepared for point questions; each part is built on first use.

    Kept as tables: ``grid``: edges per cell, ``rows``: edges per grid row, ``outline``: cells with outline per region, ``inside``:
    largest boxes inside a region.  Made from the outline when asked: ``boxes``, its cells on all levels, and ``occupied(level)``, boxes of
    any region on one level, the last being one box.  The number of cells grows with the length of the outlines / cell; a
    few edges per cell is best.
    """

    def __init__(self, regions: DataFrame, cell: float = CELL, levels: int = LEVELS, region: str = "region", wkt: str = "wkt"):
        self.edges = polygon_edges(regions, region, wkt).drop("ring")
        self.cell, self.top = float(cell), levels

    @cached_property
    def grid(self) -> DataFrame:
        return stage(edge_cells(self.edges, self.cell), "region_grid")

    @cached_property
    def rows(self) -> DataFrame:
        return stage(edge_rows(self.edges, self.cell), "region_rows")

    @cached_property
    def _outline(self) -> tuple[DataFrame, int]:
        ends = {f"{f}_{c}": getattr(F, f)(c) for f in ("min", "max") for c in ("cx", "cy")}
        cells, found = stage_measured(self.grid.select("region", "cx", "cy").distinct(), "region_outline", **ends)
        spans = [found[f"max_{c}"] - found[f"min_{c}"] for c in ("cx", "cy") if found[f"max_{c}"] is not None]
        return cells, max(spans, default=0).bit_length()

    @property
    def outline(self) -> DataFrame:
        return self._outline[0]

    @property
    def height(self) -> int:
        """Level on which the regions reach over no more than two boxes either way."""
        return self._outline[1]

    @property
    def boxes(self) -> DataFrame:
        return outline_boxes(self.outline, self.height)

    @cached_property
    def inside(self) -> DataFrame:
        return stage(inside_boxes(self.boxes, self.rows, self.cell), "region_inside")

    def occupied(self, level: int) -> DataFrame:
        at = ["0L AS kx", "0L AS ky"] if level == self.top else [f"shiftright(cx, {level}) AS kx", f"shiftright(cy, {level}) AS ky"]
        return self.outline.selectExpr(*at).distinct()

    def build(self) -> None:
        """Build all parts that are kept, as far as possible at the same time."""
        together(lambda: self.grid, lambda: self.rows)
        self.inside  # noqa: B018

    def place(self, points: DataFrame) -> DataFrame:
        """Add the grid cell of each point."""
        return points.selectExpr("*", f"floor(x / {self.cell!r}D) AS cx", f"floor(y / {self.cell!r}D) AS cy")


# --- points against regions -----------------------------------------------------------------

def distinct_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct complete points ``(x, y)``, as a table of their own: several steps read them."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return stage(points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").distinct(), "points")


def counted_cells(placed: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Cells that points lie in, with the number of parts ``salts`` each is handled in, and whether any has several."""
    counts = placed.groupBy(*keys).agg(F.expr(f"1 + count(1) DIV {CELL_POINTS}").alias("salts"))
    cells, found = stage_measured(counts, "point_cells", most=F.max("salts"))
    return cells, (found["most"] or 1) > 1


def _meet(placed: DataFrame, found: DataFrame, cells: DataFrame, crowded: bool, keys: list[str]) -> DataFrame:
    """Points with what was found for their cell.  Cells crowded with points are split; only what was found there is repeated."""
    if not crowded:
        return placed.join(found, keys)
    many = cells.where("salts > 1").select(*keys, "salts")
    spread = placed.join(many, keys, "left").selectExpr(
        *[f"`{c}`" for c in placed.columns], "CAST(pmod(xxhash64(x, y), coalesce(salts, 1)) AS INT) AS salt"
    )
    split = found.join(many, keys, "left").selectExpr(
        *[f"`{c}`" for c in found.columns], "explode(sequence(0, CAST(coalesce(salts, 1) AS INT) - 1)) AS salt"
    )
    return spread.join(split, [*keys, "salt"]).drop("salt")


def cell_regions(cells: DataFrame, index: RegionIndex) -> DataFrame:
    """``(cx, cy, region, whole)`` for cells: a region whose outline passes through, or (``whole``) that holds all of the cell.

    A cell with a ``region`` asks for that one alone.  Each cell looks for itself once per level of the quadtree.
    """
    asked = [c for c in ("region",) if c in cells.columns]
    up = cells.selectExpr("cx", "cy", *asked, f"explode(sequence(0, {max(index.height - 1, 0)})) AS level")
    up = up.selectExpr("cx", "cy", *asked, "level", "shiftright(cx, level) AS kx", "shiftright(cy, level) AS ky")
    held = up.join(index.inside, ["level", "kx", "ky", *asked]).selectExpr("cx", "cy", "region", "true AS whole")
    crossed = cells.select("cx", "cy", *asked).join(index.outline, ["cx", "cy", *asked]).selectExpr("cx", "cy", "region", "false AS whole")
    return held.unionByName(crossed)


def touching_regions(points: DataFrame, index: RegionIndex) -> DataFrame:
    """``(x, y, region, on_edge)`` for every region a distinct point lies in or on.

    With a column ``region`` in ``points`` each point is tested against that region alone.
    """
    index.build()
    keys = ["cx", "cy", *[c for c in ("region",) if c in points.columns]]
    placed = index.place(points)
    cells, crowded = counted_cells(placed, keys)
    met = _meet(placed, cell_regions(cells, index), cells, crowded, keys)
    decided = met.where("whole").selectExpr("x", "y", "region", "false AS on_edge")
    tested = met.where("NOT whole").join(index.rows, ["region", "cy"]).groupBy("x", "y", "region").agg(
        _crossings("x", "y").alias("n"), F.expr(_TOUCHES.format(x="x", y="y")).alias("on_edge")
    )
    return decided.unionByName(tested.where("on_edge OR n % 2 = 1").select("x", "y", "region", "on_edge"))


def within_regions(points: DataFrame, index: RegionIndex) -> DataFrame:
    """Regions a point lies strictly inside of; the outline does not count."""
    return touching_regions(points, index).where(~F.col("on_edge")).drop("on_edge")


def intersecting_regions(points: DataFrame, index: RegionIndex) -> DataFrame:
    """Regions a point lies in or on the outline of."""
    return touching_regions(points, index).drop("on_edge")


def region_distances(pairs: DataFrame, index: RegionIndex) -> DataFrame:
    """Distance of the given ``(x, y, region)`` pairs, 0 in or on the region.

    Pairs outside descend the region's own boxes: those that cannot hold its nearest edge are dropped before they
    are opened, so a pair meets the edges of a few boxes, found by region and box.
    """
    asked = pairs.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").selectExpr("CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "region")
    asked = stage(asked.distinct(), "asked_pairs")
    inside = stage(touching_regions(asked, index).select("x", "y", "region"), "pairs_inside")
    outside = stage(index.place(asked.join(inside, ["x", "y", "region"], "left_anti")), "pairs_outside")
    keys = ["cx", "cy", "region"]
    cells, crowded = counted_cells(outside, keys)
    height = index.height
    at_level = lambda level: index.boxes.where(f"level = {level}").drop("level")
    boxes = cells.select(*keys).join(at_level(height).withColumn("level", F.lit(height)), "region")
    candidates = _candidates(boxes, at_level, index, height, height + 1, keys)
    least = _meet(outside, candidates, cells, crowded, keys).groupBy("x", "y", "region").agg(_least_gap().alias("distance"))
    return inside.withColumn("distance", F.lit(0.0)).unionByName(least)


def cell_candidates(points: DataFrame, index: RegionIndex) -> DataFrame:
    """``(x, y, region)`` pairs worth testing: the region reaches into the point's grid cell.

    This equi-join takes the place of a points x regions product.
    """
    index.build()
    placed = index.place(points)
    cells, crowded = counted_cells(placed, ["cx", "cy"])
    return _meet(placed, cell_regions(cells, index), cells, crowded, ["cx", "cy"]).select("x", "y", "region")


def _lifted(top: int) -> list[str]:
    return [f"IF(level = {top}, 0L, shiftright({c}, level)) AS {k}" for c, k in (("cx", "kx"), ("cy", "ky"))]


def _around(df: DataFrame, radius: int) -> DataFrame:
    others = [c for c in df.columns if c not in ("kx", "ky")]
    wide = df.selectExpr(*others, "kx", f"explode(sequence(ky - {radius}, ky + {radius})) AS ky")
    return wide.selectExpr(*others, f"explode(sequence(kx - {radius}, kx + {radius})) AS kx", "ky")


def _nearest_boxes(boxes: DataFrame, cell: float, top: int, keys: list[str]) -> DataFrame:
    """Drop boxes that cannot hold the edge nearest to any point of the cell ``(cx, cy)`` (for each of ``keys``).

    Every box holds part of an edge, so some edge is no farther than the least "far" distance; a
    box whose "near" distance exceeds that is out.  A cell has a few hundred boxes at most.
    """
    width = f"{cell!r}D"
    size = f"({width} * power(2D, level))"

    def near(k: str, c: str) -> str:
        return f"greatest(0D, {k} * {size} - ({c} + 1) * {width}, {c} * {width} - ({k} + 1) * {size})"

    def far(k: str, c: str) -> str:
        return f"greatest(abs(({k} + 1) * {size} - {c} * {width}), abs(({c} + 1) * {width} - {k} * {size}))"

    whole = f"level = {top}"
    measured = boxes.selectExpr(
        "*",
        f"IF({whole}, 0D, hypot({near('kx', 'cx')}, {near('ky', 'cy')})) AS near",
        f"IF({whole}, double('Infinity'), hypot({far('kx', 'cx')}, {far('ky', 'cy')})) AS far",
    ).selectExpr("*", f"min(far) OVER (PARTITION BY {', '.join(keys)}) AS bound")
    return measured.where(f"near <= bound + {cell * 1e-5!r}D").drop("near", "far", "bound")


def _finer_boxes(boxes: DataFrame, occupied: Callable[[int], DataFrame], target: int, top: int, keys: list[str]) -> DataFrame:
    """Replace boxes up to ``OPENED`` levels above ``target`` by the occupied boxes on it inside them."""
    own = [c for c in ("region",) if c in keys]
    parents = occupied(target).selectExpr(
        *own, "kx AS fx", "ky AS fy", f"explode(sequence({target + 1}, {min(target + OPENED, top)})) AS level"
    )
    up = [f"IF(level = {top}, 0L, shiftright({f}, level - {target})) AS {k}" for f, k in (("fx", "kx"), ("fy", "ky"))]
    joined = boxes.join(parents.selectExpr(*own, "fx", "fy", "level", *up), [*own, "level", "kx", "ky"], "left")
    return joined.selectExpr(
        *keys, f"IF(fx IS NULL, level, {target}) AS level", "coalesce(fx, kx) AS kx", "coalesce(fy, ky) AS ky"
    )


def _candidates(boxes: DataFrame, occupied: Callable[[int], DataFrame], index: RegionIndex, highest: int, top: int, keys: list[str]) -> DataFrame:
    """Edges that can be nearest to the cells ``keys``: boxes up to level ``highest`` are opened down to grid cells and thinned at every step."""
    own = [c for c in ("region",) if c in keys]
    boxes = _nearest_boxes(boxes, index.cell, top, keys)
    for target in range((highest - 1) // OPENED * OPENED, -1, -OPENED):
        boxes = _nearest_boxes(_finer_boxes(boxes, occupied, target, top, keys), index.cell, top, keys)
    edges = index.grid.withColumnsRenamed({"cx": "kx", "cy": "ky"})
    return boxes.drop("level").join(edges, [*own, "kx", "ky"]).drop("kx", "ky").distinct()


def home_levels(cells: DataFrame, index: RegionIndex) -> tuple[DataFrame, int]:
    """For each cell ``(cx, cy)`` the finest level with an edge in the 3 x 3 boxes around it, and the coarsest of these levels.

    Each round looks at one level: the boxes the remaining cells lie in probe their nine neighbours once, and
    only cells without an edge there go on to the next.
    """
    rest, rounds, farthest = cells.select("cx", "cy"), [], 0
    for level in range(index.top + 1):
        at = ["0L AS kx", "0L AS ky"] if level == index.top else [f"shiftright(cx, {level}) AS kx", f"shiftright(cy, {level}) AS ky"]
        lifted = rest.selectExpr("cx", "cy", *at)
        probes = _around(lifted.select("kx", "ky").distinct().selectExpr("kx AS hx", "ky AS hy", "*"), 1)
        near = probes.join(index.occupied(level), ["kx", "ky"], "left_semi").selectExpr("hx AS kx", "hy AS ky", "true AS hit").distinct()
        marked = lifted.join(near, ["kx", "ky"], "left").select("cx", "cy", "hit")
        marked, found = stage_measured(marked, "cell_levels", left=F.bool_or(F.col("hit").isNull()))
        rounds.append(marked.where("hit").selectExpr("cx", "cy", f"{level} AS level"))
        rest, farthest = marked.where("hit IS NULL").select("cx", "cy"), level
        if not found["left"]:
            break
    return reduce(DataFrame.unionByName, rounds), farthest


def nearest_outside(points: DataFrame, index: RegionIndex) -> DataFrame:
    """Distance from distinct points outside every region to each region that could be nearest.

    An edge in the 3 x 3 boxes around a cell is less than 2 * sqrt(2) widths away, so the nearest one lies within
    three boxes of that level, and so in the 3 x 3 boxes two levels up.  Of these only those that can hold it are
    kept and opened, so that distant points do not meet every edge.
    """
    placed = index.place(points)
    cells, crowded = counted_cells(placed, ["cx", "cy"])
    home, farthest = home_levels(cells, index)
    near = home.selectExpr("cx", "cy", f"least(level + 2, {index.top}) AS level").selectExpr("*", *_lifted(index.top))
    occupied = reduce(DataFrame.unionByName, [
        index.occupied(level).withColumn("level", F.lit(level)) for level in sorted({min(n + 2, index.top) for n in range(farthest + 1)})
    ])
    boxes = _around(near, 1).join(occupied, ["level", "kx", "ky"], "left_semi")
    candidates = _candidates(boxes, index.occupied, index, min(farthest + 2, index.top), index.top, ["cx", "cy"])
    met = _meet(placed, candidates, cells, crowded, ["cx", "cy"])
    return met.groupBy("x", "y", "region").agg(_least_gap().alias("distance"))


def nearest_regions(points: DataFrame, index: RegionIndex, ties: str = "all") -> DataFrame:
    """``(x, y, region, distance)`` of the nearest region per distinct point.

    A point in or on regions has distance 0 to each of them.  ``ties="all"`` keeps every region at
    the least distance, ``"first"`` the smallest name.
    """
    index.build()
    inside = stage(intersecting_regions(points, index).withColumn("distance", F.lit(0.0)), "points_inside")
    outside = points.join(inside.select("x", "y").distinct(), ["x", "y"], "left_anti")
    measured = nearest_outside(outside, index)
    # the window holds one row per candidate region of a point
    ranked = measured.selectExpr("*", "rank() OVER (PARTITION BY x, y ORDER BY distance) AS place")
    closest = ranked.where("place = 1").drop("place")
    labels = inside.select("x", "y", "region", "distance").unionByName(closest)
    if ties == "all":
        return labels
    return labels.groupBy("x", "y").agg(F.min("region").alias("region"), F.min("distance").alias("distance"))


def label_points(
    df: DataFrame,
    labels: DataFrame,
    xy: tuple[str, str],
    out: str,
    how: str = "left",
    pick: str = "all",
) -> DataFrame:
    """Attach ``region`` of a label table to rows by equal coordinates.

    ``pick="all"`` keeps one row per matching region, ``"min"`` one row with the smallest name.
    """
    names = labels.select(F.col("x").alias(xy[0]), F.col("y").alias(xy[1]), F.col("region").alias(out))
    if pick == "min":
        names = names.groupBy(*xy).agg(F.min(out).alias(out))
    return salted_join(df, names, list(xy), how)


def dissolve(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Relabel member regions as their group, each point once per group.

    ``groups`` has ``region`` and ``area``; unlisted regions keep their name.  A point on the seam
    of two members counts once, as it would after a polygon union.
    """
    renamed = labels.join(groups.select("region", "area"), "region", "left")
    return renamed.select("x", "y", F.coalesce("area", "region").alias("region")).distinct()
