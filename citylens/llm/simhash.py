"""SimHash near-duplicates by pivot distance tables.

Fingerprints get a table of Hamming distances to reference fingerprints, segment by segment: every
reference is cut into segments, and a row holds the distance of each of its segments to each reference
segment.  Segment distances add up, and each obeys the triangle inequality, so two fingerprints that
differ in at most B bits have coordinates that differ by at most B, and with B + 2 segments at least two
segments have no coordinate difference at all.  Equal coordinates on two segments are an equi-join key:
a fingerprint that shares no key with another is discarded with all its pairs.  Survivors are verified
exactly without forming the pairs of a group.
"""

from __future__ import annotations

import random
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citylens.llm.common import map_batches, raw_bytes, without
from citylens.llm.graph import components
from citylens.session import stage

BITS, SEGMENTS, SHINGLE_SEED = 64, 4, 42
REFERENCES = 8


def shingle_digests(folded: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words joined by spaces, as rows of 8 big-endian bytes."""
    tokens = folded.split()
    if not tokens:
        return np.empty((0, 8), np.uint8)
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        made = digest(b" ".join(tokens), SHINGLE_SEED)
    else:
        joined = b" ".join(tokens)
        ends = list(accumulate(map(len, tokens), lambda a, n: a + n + 1))
        starts = [0, *[e + 1 for e in ends]]
        made = b"".join([digest(joined[s:e], SHINGLE_SEED) for s, e in zip(starts, ends[words - 1:])])
    return np.frombuffer(made, np.uint8).reshape(-1, 8)


def majority_bits(digests: np.ndarray) -> int:
    """Bits set in over half the digests, as a signed 64-bit integer; none gives zero."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[at:at + (1 << 15)], axis=1).sum(axis=0, dtype=np.uint32)
    packed = np.packbits(ones * 2 > len(digests)) if len(digests) else np.zeros(8, np.uint8)
    return int.from_bytes(packed.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_key (hash of the text) and fingerprint (long) of every whole text; null and blank texts have fingerprint zero."""
    def work(batch: pa.RecordBatch) -> dict:
        found = [majority_bits(shingle_digests(t.lower(), words)) for t in raw_bytes(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fingerprint": found}

    read = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), F.col("text").cast("string"))
    return map_batches(read, work, "doc_id long, text_key long, fingerprint long")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def reference_segments(width: int) -> list[int]:
    """Fixed references: a seeded draw, the same in every run."""
    draw = random.Random(1)
    return [draw.getrandbits(width) for _ in range(REFERENCES)]


def pivot_table(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Add ``pivots``: per segment one number that packs its distances to all reference segments."""
    width = BITS // segments
    mask = (1 << width) - 1
    packed = []
    for s in range(segments):
        piece = F.shiftrightunsigned("fingerprint", s * width).bitwiseAND(F.lit(mask))
        row = F.lit(0).cast("long")
        for j, reference in enumerate(reference_segments(width)):
            row = row.bitwiseOR(F.shiftleft(F.bit_count(piece.bitwiseXOR(F.lit(reference))).cast("long"), 6 * j))
        packed.append(row)
    return prints.withColumn("pivots", F.array(*packed))


def pivot_survivors(prints: DataFrame, bits: int) -> DataFrame:
    """Fingerprints that share equal coordinates on two segments with another fingerprint."""
    if bits + 2 > SEGMENTS:
        raise ValueError("two equal segments are certain only for at most SEGMENTS - 2 differing bits")
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("pivots")[i], F.col("pivots")[j]) for n, (i, j) in enumerate(combinations(range(SEGMENTS), 2))])
    rows = stage(pivot_table(prints).select("fingerprint", F.explode(keys).alias("key")), "pivot-rows")
    shared = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "pivot-keys")
    return rows.join(shared, "key", "left_semi").select("fingerprint").distinct()


def close_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits, without all their pairs.

    Two fingerprints differ in at most two bits exactly if some value is within one bit of both.  Every
    survivor is listed under the 65 values within one bit of it; all fingerprints under one value (65 at
    most) are within two bits of each other, so linking each to the smallest keeps every connection.
    """
    survivors = pivot_survivors(prints, 2)
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = survivors.select("fingerprint", F.explode(F.transform(flips, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("middle"))
    low = F.min("fingerprint").over(W.partitionBy("middle"))
    return near.select(low.alias("a"), F.col("fingerprint").alias("b")).filter("a <> b").distinct()


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def simhash_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (long) and component_id (smallest doc_id reachable) for each row.

    Fingerprints link at two or fewer differing bits.  Null and blank texts have fingerprint zero and
    link like any other; a null doc_id names a component only if it has no other id.  Repeated rows come
    back as often as they went in; an empty table gives no rows; other columns are ignored.
    """
    return _placed(docs, words).select("doc_id", "fingerprint", "component_id")


def _placed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, fingerprint and component_id for each row."""
    prints = stage(fingerprints(docs, words), "fingerprints")
    distinct = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "fingerprint-set")
    linked = components(close_links(distinct.select("fingerprint")))
    placed = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("component"))
    placed = stage(placed, "fingerprint-components")
    names = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    named = stage(placed.join(names, "component").select("fingerprint", "component", "component_id"), "fingerprint-names")
    return prints.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each group of ``simhash_groups`` stays, with its columns as they are: the one with the smallest doc_id.

    Among rows that share this doc_id the one with the least hash of its text stays, among equal rows any one.  Null and
    blank texts are one group; without any doc_id in a group one of its rows stays; very long texts are read whole; an
    empty table stays empty.
    """
    rows = stage(_placed(docs, words), "near-rows")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.filter(named).groupBy("component").agg(F.min("text_key").alias("first_key"))
    decided = rows.join(first, "component").select("doc_id", F.col("text_key").alias("key"), (named & (F.col("text_key") == F.col("first_key"))).alias("kept"))
    return without(docs, _text_key(), decided)
