"""Joins: skew-proof lookup, label with fallback, near points, semi joins.

No broadcast hints are used.  Spark broadcasts a side only when its size, known from the plan or
measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``; otherwise these joins
shuffle on their keys, and a sketch made before names the keys that one task cannot take.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.session import plan_bytes, stage


HOT_ROWS = 1_000_000  # rows of one key that one task takes
SMALL_BYTES = 32 << 20  # a side below this is one task's share as a whole
TRACKED, NAMED = 10_000, 100  # keys the sketch follows, and the most it names
FINE_BITS = 6  # cells of near points are 64 times as wide as the distance
CROWD = 256  # labels in a cell from which it is taken apart


def hot_keys(df: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> dict[int, int]:
    """Keys with more than ``rows`` rows, by hash, and the number of parts to split them into.

    One pass over the key columns with a mergeable sketch of fixed size.  A key it does not name has less than a
    hundredth of all rows, so it does not stand out.
    """
    keys = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in on]).alias("_key"))
    top = keys.agg(F.expr(f"approx_top_k(_key, {NAMED}, {TRACKED})").alias("top")).first()["top"]
    return {item: -(-count // rows) for item, count in top or [] if count > rows}


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows: int = HOT_ROWS,
    spread: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join that splits keys with more than ``rows`` rows in ``big`` over several tasks.

    Rows of ``small`` are repeated only for those keys, once per part, so each row of ``big`` still meets every
    matching row exactly once; without such a key, or in a small ``big``, nothing is repeated.  The part is a hash of the row (or of
    ``spread``) and of the task it is read in, never random: a retried task sends its rows to the same place, and
    equal rows of different tasks spread.  ``how`` is inner, left, left_semi or left_anti.
    ``null_safe`` lets missing keys meet (semi and anti joins only).
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salted_join cannot keep {how} rows exact")
    if null_safe and how not in {"left_semi", "left_anti"}:
        raise ValueError("null_safe needs a semi or anti join")
    parts, salt = hot_keys(big, on, rows) if rows < HOT_ROWS or plan_bytes(big) > SMALL_BYTES else {}, []
    if parts:
        # The hash of a key depends on its type; both sides use the type of ``big``.
        types = dict(big.dtypes)
        listed = F.create_map(*[F.lit(v) for pair in parts.items() for v in pair])
        key = F.xxhash64(*[F.col(f"`{c}`").try_cast(types[c]) for c in on])
        many = F.coalesce(F.try_element_at(listed, key), F.lit(1))
        source = [F.col(f"`{c}`") for c in (spread or big.columns)]
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*source, F.spark_partition_id()), many).cast("int"))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
        salt = ["_salt"]
    if null_safe:
        same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*on, *salt]]
        return big.alias("l").join(small.alias("r"), same, how).drop(*salt)
    return big.join(small, [*on, *salt], how).drop(*salt)


def lookup_default(df: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    """Replace a code by its label, keeping the code where none is known.

    ``labels`` has columns ``code`` and ``label`` with one row per code.
    """
    names = labels.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    joined = df.join(names, F.col(key) == F.col("_code"), "left")
    return joined.withColumn(out, F.coalesce("_label", key)).drop("_code", "_label")


def lookup_all(df: DataFrame, columns: dict[str, str], labels: DataFrame) -> DataFrame:
    """``lookup_default`` for several columns: ``{column: output}``."""
    for key, out in columns.items():
        df = lookup_default(df, key, labels, out)
    return df


def _cells_near(index: Column) -> Column:
    """Wide cells that lie within one narrow cell of the narrow cell ``index``: one, or two beside a border."""
    return F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.shiftright(index + d, FINE_BITS)))


def within_distance(
    left: DataFrame,
    right: DataFrame,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    eps: float,
    crowd: int = CROWD,
) -> DataFrame:
    """All pairs whose points are at most ``eps`` apart, as an equi-join on grid cells.

    Cells are 64 narrow cells wide, and a narrow one is a little wider than ``eps``.  The right side is listed in its own
    cell, and in a neighbour only where it lies within a narrow cell of that border: about 1.06 times.  Cells with more than ``crowd`` rows of the
    right side are taken apart into narrow cells, listed with those around them.  Every near pair shares exactly
    one key and the exact distance test decides.  The right side should be the smaller one (labels of distinct points).
    """
    width = eps * 1.001
    (lx, ly), (rx, ry) = left_xy, right_xy

    def narrow(df: DataFrame, x: str, y: str) -> DataFrame:
        known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        return known.withColumns({"_fx": F.floor(F.col(x) / F.lit(width)), "_fy": F.floor(F.col(y) / F.lit(width))})

    l2 = narrow(left, lx, ly).withColumns({"_gx": F.shiftright("_fx", FINE_BITS), "_gy": F.shiftright("_fy", FINE_BITS)})
    r2 = narrow(right, rx, ry).withColumn("_gx", F.explode(_cells_near(F.col("_fx")))).withColumn("_gy", F.explode(_cells_near(F.col("_fy"))))
    keys = ["_gx", "_gy"]
    counted = r2.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (counted.agg(F.max("_n")).first()[0] or 0) > crowd:
        marks = stage(counted.where(F.col("_n") > crowd).select(*keys, F.lit(True).alias("_split")), "crowded_cells")

        def place(wide: str, fine: Column) -> Column:
            """Number of a narrow cell inside its wide one from 1, 0 in cells that stay whole, missing outside."""
            inside = fine - F.shiftleft(wide, FINE_BITS)
            return F.when(F.col("_split").isNull(), F.lit(0).cast("long")).when(inside.between(0, (1 << FINE_BITS) - 1), inside + 1)

        def around(wide: str, fine: str) -> Column:
            listed = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: place(wide, F.col(fine) + d))
            return F.explode(F.array_distinct(F.filter(listed, lambda p: p.isNotNull())))

        l2 = l2.join(marks, keys, "left").withColumns({"_sx": place("_gx", F.col("_fx")), "_sy": place("_gy", F.col("_fy"))}).drop("_split")
        r2 = r2.join(marks, keys, "left").withColumn("_sx", around("_gx", "_fx")).withColumn("_sy", around("_gy", "_fy")).drop("_split")
        keys = [*keys, "_sx", "_sy"]
    pairs = salted_join(l2.drop("_fx", "_fy"), r2.drop("_fx", "_fy"), keys)
    gap = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return pairs.where(gap <= F.lit(eps)).drop(*keys)


def keep_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is present in ``keys`` (semi join: rows never multiply)."""
    return salted_join(df, keys.select(*on).distinct(), on, "left_semi")


def zone_flags(df: DataFrame, name: str, zones: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One boolean per zone for the place in ``name``.

    ``zones`` has ``name`` and boolean columns; ``flags`` maps zone column to output column.  A
    place may lie in several zones; with one row per place the rows of ``df`` stay single.  An
    unknown or missing place is in no zone.
    """
    dim = zones.select(F.col("name").alias("_place"), *[F.col(z).alias(f"_{z}") for z in flags])
    joined = df.join(dim, F.col(name) == F.col("_place"), "left")
    for zone, out in flags.items():
        joined = joined.withColumn(out, F.coalesce(F.col(f"_{zone}"), F.lit(False)))
    return joined.drop("_place", *[f"_{z}" for z in flags])
