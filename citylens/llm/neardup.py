"""Near copies: texts whose distinct five-word shingles have a Jaccard similarity of 0.8 or more, without a miss.

Shingles get one order for all texts, the rare ones first.  Two sets of at most L shingles that are similar
enough have one in common among the first L - ceil(0.8 L) + 1 of each (prefix filter, true for any order), so
texts meet in the lists of those shingles, and passages that many texts share come too late in the order to
bring them together.  Pairs that the number of common prefix shingles or the sizes rule out are discarded;
each other pair is verified once on whole shingle sets.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citylens.llm.common import KEY_SLOTS, in_map, map_batches, raw_bytes, slot, slot_map, without
from citylens.llm.graph import components
from citylens.llm.simhash import shingle_digests
from citylens.session import stage

WORDS = 5
# The least similarity as a fraction.
PART, WHOLE = 4, 5
# Frequencies come from one text in so many; they only set the order of the shingles, any order gives the same links.
SAMPLED, ORDER_SLOTS = 16, 1 << 22
# Texts of longer lists meet one of them first, so many times at most, and only texts of different components meet afterwards.
SMALL_LIST, STARS = 16, 3
BANDS, ROWS = 24, 8

MULTIPLY = np.array([random.Random(n).getrandbits(64) | 1 for n in range(BANDS * ROWS)], np.uint64)


def text_key(folded: bytes) -> str:
    return xxhash.xxh128_hexdigest(folded)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One number per band of min-hashes of a shingle set; none for a text without words."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096, None] * MULTIPLY[None, :]
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(low.reshape(BANDS, ROWS))]


def shingle_set(digests: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(digests).view(">u8").ravel().astype(np.uint64))


def shingle_order(docs: DataFrame) -> np.ndarray:
    """Frequency class of the shingles of each slot: zero for rare ones, up to 255."""
    def work(batch: pa.RecordBatch) -> dict | None:
        found = [shingle_set(shingle_digests(t, WORDS)) for t in (t.lower() for t in raw_bytes(batch, "text")) if xxhash.xxh64_intdigest(t) % SAMPLED == 0]
        return {"shingle": np.concatenate(found).view(np.int64)} if found else None

    seen = map_batches(docs.select(F.col("text").cast("string")), work, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    top = seen.groupBy(F.pmod("shingle", F.lit(ORDER_SLOTS)).alias("slot")).agg(F.max("n").alias("n")).toArrow()
    order = np.zeros(ORDER_SLOTS, np.uint8)
    order[top["slot"].to_numpy()] = np.minimum(8 * np.log2(top["n"].to_numpy()), 255)
    return order


def prefix(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a similar set shares one with its own."""
    # Slots are those of the signed numbers: ORDER_SLOTS divides 2 to the power of 64.
    ranked = np.lexsort((hashes, order[hashes % np.uint64(ORDER_SLOTS)]))
    return hashes[ranked[:len(hashes) - (PART * len(hashes) + WHOLE - 1) // WHOLE + 1]] if len(hashes) else hashes


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, number of distinct shingles and prefix shingles of every whole text."""
    order = docs.sparkSession.sparkContext.broadcast(shingle_order(docs))

    def work(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "key": [], "size": [], "prefix": []}
        for text in raw_bytes(batch, "text"):
            folded = text.lower()
            hashes = shingle_set(shingle_digests(folded, WORDS))
            out["key"].append(text_key(folded))
            out["size"].append(len(hashes))
            out["prefix"].append(prefix(hashes, order.value).view(np.int64))
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, key string, size long, prefix array<long>")


def list_rows(sketched: DataFrame) -> DataFrame:
    """token, key and size for each prefix shingle of several texts; few of a single text remain."""
    shared = sketched.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = slot_map(shared.select(F.pmod("token", F.lit(KEY_SLOTS)).alias("slot")))
    bits = np.zeros((KEY_SLOTS // 32768 + 1, 4096), np.uint8)
    for bucket, part in found.value.items():
        bits[bucket] = np.frombuffer(part, np.uint8)
    known = sketched.sparkSession.sparkContext.broadcast(bits)

    def work(batch: pa.RecordBatch) -> dict:
        column = batch.column("prefix")
        tokens = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = tokens % KEY_SLOTS
        place = np.where(at > 0, (at - 1) % 32768, 0)
        kept = (known.value[(at + 32767) // 32768, place // 8] >> (place % 8) & 1).astype(bool)
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))[kept]
        return {"token": tokens[kept], "key": batch.column("key").take(pa.array(owner)), "size": batch.column("size").take(pa.array(owner))}

    return map_batches(sketched.select("key", "size", "prefix"), work, "token long, key string, size long").distinct()


def shingle_sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """key and distinct shingles of the texts in ``pairs``."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = stage(map_batches(keys, lambda b: {"key": b.column("key"), "slot": [slot(k) for k in b.column("key").to_pylist()]}, "key string, slot long"), "near-wanted")
    known = slot_map(wanted)

    def work(batch: pa.RecordBatch) -> dict | None:
        keys, sets = [], []
        for text in raw_bytes(batch, "text"):
            folded = text.lower()
            key = text_key(folded)
            if in_map(known.value, key):
                keys.append(key)
                sets.append(shingle_set(shingle_digests(folded, WORDS)).view(np.int64))
        return {"key": keys, "shingles": sets} if keys else None

    made = map_batches(docs.select(F.col("text").cast("string")), work, "key string, shingles array<long>")
    return made.join(wanted.select("key").hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    sets = stage(shingle_sets(docs, pairs), "near-sets")
    a, b = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    similar = WHOLE * shared >= PART * (F.size("a_set") + F.size("b_set") - shared)
    return stage(pairs.select("a", "b").join(a, "a").join(b, "b").filter(similar).select("a", "b"), "near-links")


def sizes_fit(a: str, b: str) -> Column:
    return WHOLE * F.least(a, b) >= PART * F.greatest(a, b)


def crossing(rows: DataFrame) -> DataFrame:
    """The pairs of texts of different components that share enough prefix shingles to be similar.

    The texts outside the largest component of a list meet all its texts, so members of that component
    do not meet each other.
    """
    sizes = stage(rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    main = sizes.groupBy("token").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("token", F.col("m.component").alias("main"))
    mixed = stage(rows.join(main, "token"), "near-mixed")
    outer = mixed.filter("component <> main").select("token", F.col("key").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_component"))
    once = (F.col("component") == F.col("main")) | (F.col("a") < F.col("key"))
    met = mixed.join(outer, "token").filter((F.col("a_component") != F.col("component")) & once & sizes_fit("a_size", "size"))
    # A pair may come in either order in different lists.
    each = met.select(
        F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"), (F.col("a_size") + F.col("size")).alias("both"), F.greatest("a_size", "size").alias("longer"),
    ).groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.first("both").alias("both"), F.first("longer").alias("longer"))
    # Common shingles outside both prefixes are among the last ceil(0.8 L) - 1 of the text whose prefix ends first.
    most = F.col("met") + F.floor((PART * F.col("longer") + WHOLE - 1) / WHOLE) - 1
    return stage(each.filter((PART + WHOLE) * most >= PART * F.col("both")).select("a", "b"), "near-pairs")


def near_links(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Links (a, b) between keys of near copies; their components are those of all pairs that are similar.

    The texts of a long list first meet one of them, so that a large group of copies becomes one
    component without forming its pairs.  Then all texts of different components meet.
    """
    rows = stage(list_rows(sketched), "near-rows")
    long = stage(rows.join(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL_LIST), "token").drop("n"), "near-long")
    links, joined = None, None

    def placed(some: DataFrame) -> DataFrame:
        if joined is None:
            return some.withColumn("component", F.col("key"))
        return some.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))

    for star in range(STARS):
        leads = placed(long).withColumn("turn", F.xxhash64("key", F.lit(star)))
        first = leads.groupBy("token").agg(F.min(F.struct("turn", "key", "size", "component")).alias("f")).select("token", "f.key", "f.size", "f.component").toDF("token", "a", "a_size", "a_component")
        met = leads.join(first, "token").filter((F.col("component") != F.col("a_component")) & sizes_fit("a_size", "size"))
        pairs = stage(met.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct(), "near-pairs")
        if pairs.isEmpty():
            break
        found = verified(docs, pairs)
        links = found if links is None else links.unionByName(found)
        joined = components(links).withColumnRenamed("node", "key")
    found = verified(docs, crossing(placed(rows)))
    return found if links is None else links.unionByName(found)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, key and kept for each row: of a group of near copies the row with the smallest doc_id stays.

    Texts that are equal after lower-casing A-Z are one text; null counts as empty.  A null doc_id is
    kept only if its group has no other; rows that tie in text and doc_id keep one.  An empty table
    gives no rows; columns other than doc_id and text are ignored.
    """
    sketched = stage(sketches(docs), "near-sketches")
    linked = components(near_links(docs, sketched)).withColumnRenamed("node", "key")
    rows = sketched.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("rows")).join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = stage(rows, "near-rows")
    # A null id comes last.
    best = stage(rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")), "near-best")
    each = rows.join(best, "component").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    stays = (F.col("key") == F.col("best.key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == 1)
    return each.select("doc_id", "key", "component", stays.alias("kept"))


@F.pandas_udf(T.StringType())
def _key_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: text_key((t or "").encode().lower()))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    return without(docs, _key_column(F.coalesce(F.col("text").cast("string"), F.lit(""))), near_groups(docs).drop("component"))
