"""Mixing sources to target weights by capped water-filling.

Weights share a budget; a source stops at ``epochs`` times its own size and what it cannot take goes to
the others in proportion to their weights, round after round, until no source is above its limit.  A
source's target is then taken as whole repetitions of all its documents plus a fractional one: its
documents in seeded order up to the words that are left, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citylens.llm.common import WORD, fresh_name
from citylens.session import stage

# Hex digits that make a slice of the seeded order; only one slice per source is ordered row by row.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def rank_sources(sizes: DataFrame) -> DataFrame:
    """Add ``position``: 0-based rank of a source by code point, null last, over any number of sources.

    Range partitions are numbered first; the only driver data are the counts of those partitions.
    """
    ordered = [F.col("source").isNull(), F.col("source")]
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(sizes.repartitionByRange(parts, *ordered).withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())
    before, total = [], 0
    for part, count in counts:
        before += [F.lit(part), F.lit(total)]
        total += count
    offset = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    number = F.row_number().over(W.partitionBy("part").orderBy(*ordered))
    return dealt.withColumn("position", (offset + number - 1).cast("long")).drop("part")


def fill_targets(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """(source, size) with its target.  Each round is one aggregate over the source table."""
    ranked = stage(rank_sources(sizes).withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")),
        "limit": F.col("size") * F.lit(float(epochs)),
    }), "mix-weights")
    budget = float(ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * share
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("limit")
        clamped, taken, rest = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("limit")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if clamped == full or not rest:
            break
        full, level = clamped, (budget - taken) / rest
    # The level only rises, so sources once full stay full; the loop ends when no further one fills.
    target = F.when(over, F.col("limit")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", F.col("size").alias("source_size"), target.alias("target"))


def order_key(seed: int) -> Column:
    """Place of a row in the seeded order: md5 of seed, id and text, so it does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))


def plan_mix(sized: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """One row per source: size, target, whole repetitions and where its fractional repetition ends.

    ``sized`` has source, size and mix_key.  The words before each slice of the seeded order come from
    sums per slice; rows are ordered one by one only in the slice where the fraction ends.
    """
    targets = stage(fill_targets(sized.groupBy("source").agg(F.sum("size").alias("size")), list(weights), share, epochs), "mix-targets")
    goal = F.floor(F.col("target") + 0.5)
    targets = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", goal - F.col("repeats") * F.col("source_size"))
    part = F.substring("mix_key", 1, SLICE_DIGITS)
    earlier = lambda *order: F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    crosses = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    rest = targets.select(F.col("source").alias("of"), "rest")
    slices = sized.groupBy("source", part.alias("slice")).agg(F.sum("size").alias("words")).withColumn("before", earlier("slice"))
    slices = slices.join(rest, F.col("source").eqNullSafe(F.col("of"))).filter(crosses).select("of", "rest", F.col("slice").alias("last"), F.col("before").alias("start"))
    inside = sized.withColumn("slice", part).join(slices, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("last")))
    keys = inside.groupBy("source", "mix_key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    keys = keys.withColumn("before", F.col("start") + earlier("mix_key")).filter(crosses)
    ends = keys.select(F.col("source").alias("of"), F.col("mix_key").alias("end_key"), (F.col("rest") - F.col("before")).alias("end_words"), F.col("rows").alias("end_rows"))
    return stage(targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest"), "mix-plan")


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and mix_taken to rows that have source, size and mix_key."""
    plan = plan.withColumnRenamed("source", "of")
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    extra = F.when(F.col("mix_key") < F.col("end_key"), F.col("mix_size")).when(
        F.col("mix_key") == F.col("end_key"), F.least(F.col("mix_size"), F.floor(F.col("end_words") / F.col("end_rows")))).otherwise(0)
    taken = (F.col("repeats") * F.col("mix_size") + extra).cast("long")
    return met.withColumn("mix_taken", taken).drop("of", "repeats", "end_key", "end_words", "end_rows")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for each document.

    Null text has size 0; a null source is a source, the last by rank.  Rows equal in id and text share
    a place in the order, and split what falls on it evenly.  An empty table gives no rows.  Other
    columns are ignored.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(seed).alias("mix_key")), "mix-sizes")
    plan = plan_mix(sized, weights, share, epochs)
    return take(sized.withColumnRenamed("size", "mix_size"), plan).select("doc_id", "source", F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_taken").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``mix_copy`` (another name if ``docs`` has it), one row per repetition.

    The last repetition of one document per source may hold its first words only.  A document that the
    mix leaves out has no row.  ``n_chars``, if there, is that of the text that is returned.
    """
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], "source", "text", word_count(F.col("text")).alias("mix_size"), order_key(seed).alias("mix_key"))
    sized = stage(docs.select("source", word_count(F.col("text")).alias("size"), order_key(seed).alias("mix_key")), "mix-sizes")
    both = take(rows, plan_mix(sized, weights, share, epochs))
    copies = F.when(F.col("mix_size") > 0, F.ceil(F.col("mix_taken") / F.col("mix_size"))).otherwise(0)
    out = both.filter(copies > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
    out = out.withColumn("mix_words", F.least(F.col("mix_size"), F.col("mix_taken") - (F.col("mix_copy") - 1) * F.col("mix_size")))
    # Cut after each word; the first pieces joined are the text up to the end of that word.
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(ends, 1, F.col("mix_words").cast("int")), "")
    text = F.when(F.col("mix_words") >= F.col("mix_size"), F.col("text")).otherwise(cut)
    shown = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[(shown.get(c, F.col(f"in_{i}"))).alias(c) for i, c in enumerate(names)], F.col("mix_copy").alias(fresh_name(docs, "mix_copy")))
