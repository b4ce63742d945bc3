"""Phrase collocations from stripes.

A stripe is keyed by a prefix of one or more words and counts the words that come next.  Each task builds
the stripes of its own texts, stripes of one prefix are merged element by element in key order, and three
things are read from the merged stripes: extensions (an entry is the count of the phrase "prefix next"),
prefix totals (the entry of a prefix in the stripe that is one word shorter) and subsumption maxima (the largest
entry says whether a longer phrase is as frequent as its prefix).

Only extensions of frequent phrases can be frequent, so stripes grow in four scans: the empty prefix (a word
count), prefixes of one word, of two, and all longer ones.  Between scans a bitmap of fixed size for each length
tells tasks which phrases may be frequent; what it lets through by chance is dropped when stripes are merged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citylens.llm.bitmaps import Bitmap
from citylens.llm.common import pa_schema
from citylens.llm.words import Words, chunks, joined, read_words, separators
from citylens.session import stage

PIECES = separators(b" \t", b".,;:!?\n\r\v\f")

# Slots of a bitmap of frequent phrases of one length: 16 MB however many there are.
BITMAP_BITS = 27
# A lead (a frequent phrase that prefixes begin with) with more than this share of all words has its stripes split by next word:
# at most so many leads exist, and a part of a stripe holds about this share of the words.
HOT_SHARE = 4096

# Stripes travel in packs by the hash of their prefix: at least so many for each language, and one for so many words.
PACKS, PACK_WORDS = 128, 5_000_000

PACK = "lang string, pack int, stripes array<struct<prefix:string,part:int,nexts:string,counts:binary>>"
MERGED = "lang string, prefix string, part int, best long, nexts array<string>, counts array<long>"


def _turned(marks: np.ndarray, by: int) -> np.ndarray:
    return marks << np.uint64(by) | marks >> np.uint64(64 - by) if by else marks


def _mark_column() -> Column:
    """Mark of a phrase: the hashes of its words, each turned by 13 bits more than the one before, and of its language."""
    turned = "shiftleft(xxhash64({0}), {1}) | shiftrightunsigned(xxhash64({0}), 64 - {1})"
    words = f"transform(split(phrase, ' '), (w, i) -> {turned.format('w', '13 * i')})"
    return F.expr(f"aggregate({words}, {turned.format('lang', '7')}, (h, x) -> h ^ x)")


def _hash(text: bytes) -> int:
    """The hash of a text that Spark's xxhash64 gives."""
    return xxhash.xxh64_intdigest(text, 42)


class Frequent:
    """What tasks know of frequent phrases of one length: a bitmap of their marks, and the parts of hot leads."""

    def __init__(self, phrases: DataFrame, words: int):
        marked = phrases.select(_mark_column().alias("mark"), "a")
        self.bitmap = Bitmap(marked, BITMAP_BITS)
        hot = marked.filter(F.col("a") * HOT_SHARE > words).select("mark", F.ceil(F.col("a") * HOT_SHARE / words).cast("long").alias("parts"))
        rows = sorted(hot.groupBy("mark").agg(F.max("parts")).collect())
        self.hot = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)

    def may_be(self, marks: np.ndarray) -> np.ndarray:
        """False only for phrases that are not frequent."""
        return self.bitmap.contains(marks)

    def parts(self, marks: np.ndarray) -> np.ndarray:
        """Into how many parts the stripes of these leads are split."""
        keys, parts = self.hot
        if not len(keys):
            return np.ones(len(marks), np.int64)
        at = np.minimum(np.searchsorted(keys, marks.view(np.int64)), len(keys) - 1)
        return np.where(keys[at] == marks.view(np.int64), parts[at], 1)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for chunk in chunks(batches):
        langs = chunk.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            words = read_words(chunk.column("text").take(pa.array(np.flatnonzero(codes == code))), PIECES, fold=True)
            if len(words.codes):
                yield lang, words


def _scan(docs: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` to the words of each chunk and language; it yields lists of columns."""
    target = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_lang(batches):
            for columns in work(lang, words):
                rows = len(columns[0])
                made = [pa.array([lang], pa.string()).take(pa.array(np.zeros(rows, np.int64))), *columns]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, target)], schema=target)

    return docs.mapInArrow(run, schema)


def _word_counts(lang: str, words: Words) -> Iterator[list[pa.Array]]:
    yield [words.names.cast(pa.string()), pa.array(np.bincount(words.codes, minlength=len(words.names)))]


def _packed(names: pa.Array, prefixes: pa.Array, marks: np.ndarray, prefix: np.ndarray, follower: np.ndarray, counts: np.ndarray, parts: np.ndarray, packs: int) -> list[pa.Array]:
    """Packs of the stripes of pairs sorted by prefix and follower; ``parts`` says into how many parts the stripe of a pair is split."""
    part = np.zeros(len(prefix), np.int64)
    cut = np.flatnonzero(parts > 1)
    if len(cut):
        used, back = np.unique(follower[cut], return_inverse=True)
        spread = np.fromiter((zlib.crc32(x) for x in names.take(pa.array(used)).to_pylist()), np.int64, len(used))
        part[cut] = spread[back] % parts[cut]
    pack = ((marks[prefix] >> np.uint64(8)).astype(np.int64) + part) % packs
    order = np.lexsort((part, prefix, pack))
    pack, prefix, follower, counts, part = pack[order], prefix[order], follower[order], counts[order], part[order]
    edge = np.flatnonzero(np.diff(prefix, prepend=-1).astype(bool) | np.diff(part, prepend=-1).astype(bool))
    ends = np.append(edge[1:], len(prefix))
    bounds = pa.py_buffer((np.append(edge, len(prefix)) * 8).astype(np.int32))
    weights = pa.Array.from_buffers(pa.binary(), len(edge), [None, bounds, pa.py_buffer(counts.astype("<i8"))])
    columns = [prefixes.take(pa.array(prefix[edge])).cast(pa.string()), pa.array(part[edge].astype(np.int32)), joined(names, follower, ends - edge).cast(pa.string()), weights]
    stripes = pa.StructArray.from_arrays(columns, ["prefix", "part", "nexts", "counts"])
    first = np.flatnonzero(np.diff(pack[edge], prepend=-1))
    return [pa.array(pack[edge][first].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(first, len(edge)).astype(np.int32)), stripes)]


def _stripes(frequent: list[Frequent], longest: int, packs: int):
    """Work of a scan: stripes of prefixes as long as the longest known frequent phrases, up to ``longest`` words.

    A phrase may be frequent if its bitmap says so, or, where there is none, if both phrases that are a word shorter may be.
    """
    def work(lang: str, words: Words) -> Iterator[list[pa.Array]]:
        codes, size = words.codes.astype(np.int64), len(words.names)
        each = np.fromiter(map(_hash, words.names.to_pylist()), np.uint64, size)
        alone = each ^ _turned(np.array([_hash(lang.encode())], np.uint64), 7)
        at = np.flatnonzero(frequent[0].may_be(alone)[codes])
        # Phrases that begin at each of ``at``: number, and mark; ``names`` and ``leads`` are by number.
        phrase, marks, names, leads = codes[at], alone[codes[at]], words.names, alone
        for length in range(1, longest + 1):
            if length == len(frequent):
                parts = frequent[-1].parts(leads)
            begins = np.zeros(len(codes) + 1, bool)
            begins[at] = True
            goes_on = begins[at + 1]
            goes_on[goes_on] = words.follows[at[goes_on] + 1]
            at, phrase, marks = at[goes_on], phrase[goes_on], marks[goes_on]
            follower = codes[at + length]
            marks = marks ^ _turned(each[follower], 13 * length)
            if length < len(frequent):
                usual = frequent[length].may_be(marks)
                at, phrase, marks, follower = at[usual], phrase[usual], marks[usual], follower[usual]
            if not len(at):
                return
            pairs, places, phrase, counts = np.unique(phrase * size + follower, return_index=True, return_inverse=True, return_counts=True)
            head, tail = pairs // size, pairs % size
            if length >= len(frequent):
                yield _packed(words.names, names, leads, head, tail, counts, parts[head], packs)
                parts = parts[head]
            if length < longest:
                leads, names = marks[places], pc.binary_join_element_wise(names.take(pa.array(head)), words.names.take(pa.array(tail)), b" ")

    return work


def merge_stripes(packs: DataFrame, least: int) -> DataFrame:
    """Merged stripes with their entries of ``least`` or more; see ``MERGED``.

    Packs with one number stand together after the sort and are merged as they come, so a task holds the different
    entries of one pack: the stripes of some ``PACK_WORDS`` words.  Stripes without a frequent entry are left out.
    """
    target = pa_schema(packs.sparkSession, MERGED)

    def entries(stripes: pa.StructArray) -> pa.Table:
        lists = pc.split_pattern(stripes.field("nexts"), " ")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = pa.array(np.repeat(np.arange(len(stripes)), lengths))
        weights = np.frombuffer(b"".join(stripes.field("counts").to_pylist()), "<i8")
        return pa.table({"prefix": stripes.field("prefix").take(row), "part": stripes.field("part").take(row), "next": lists.flatten(), "n": weights})

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["prefix", "part", "next"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["prefix", "part", "next", "n"])

    def finished(lang: str, table: pa.Table) -> pa.RecordBatch:
        coded = table["prefix"].combine_chunks().dictionary_encode()
        part, n = table["part"].to_numpy().astype(np.int64), table["n"].to_numpy()
        keys, group = np.unique(coded.indices.to_numpy().astype(np.int64) << 32 | part, return_inverse=True)
        best = np.zeros(len(keys), np.int64)
        np.maximum.at(best, group, n)
        known = np.flatnonzero(n >= least)
        known = known[np.argsort(group[known], kind="stable")]
        found = np.bincount(group[known], minlength=len(keys))
        kept = np.flatnonzero(found)
        bounds = pa.array(np.concatenate([[0], np.cumsum(found[kept])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, x) for x in (table["next"].combine_chunks().take(pa.array(known)), pa.array(n[known]))]
        columns = [pa.array([lang] * len(kept), pa.string()), coded.dictionary.take(pa.array(keys[kept] >> 32)), pa.array(keys[kept] & 0xFFFFFFFF), pa.array(best[kept]), *lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tables, waiting = None, [], 0
        for batch in batches:
            lists = batch.column("stripes")
            for row, here in enumerate(zip(batch.column("lang").to_pylist(), batch.column("pack").to_pylist())):
                if here != key:
                    if tables:
                        yield finished(key[0], summed(tables))
                    key, tables, waiting = here, [], 0
                tables.append(entries(lists[row].values))
                waiting += len(tables[-1])
                if waiting > 1_000_000:  # equal entries become one now and then
                    tables, waiting = [summed(tables)], 0
        if tables:
            yield finished(key[0], summed(tables))

    keys = ["lang", "pack"]
    return packs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, MERGED)


def _extensions(merged: DataFrame) -> DataFrame:
    pairs = merged.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    return pairs.select("lang", F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"), F.col("e.counts").alias("a"))


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by collocation score.

    Returns lang, rank (from 1), phrase, a, l, r, n, score.  A-Z count as a-z.  A phrase lies within a piece of
    text between ``.,;:!?`` and line ends and occurs ``a`` >= ``least`` times, overlaps included.  Cut after its first k
    words, the parts occur l and r times, n is the number of words of the language; the cut with the least floor(1000 a n /
    (l r)) counts, of ties the first.  Phrases inside a longer one that is as frequent are left out.  Order: score and a
    descending, phrase in UTF-8 byte order.  Null text is empty, null lang is ``und``; repeated rows count as often as
    they are there; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = _scan(read, _word_counts, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    words = stage(words.withColumn("frequent", F.col("a") >= least), "phrase-words")
    sizes = stage(words.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    units = words.filter("frequent").select("lang", "phrase", "a")
    stripes, known, packs = None, [Frequent(units, total)], max(PACKS, total // PACK_WORDS)
    # Prefixes of one word, of two, and of all other lengths at once.
    for upto in [n for n in (1, 2, longest - 1) if n <= longest - 1][:longest - 1]:
        made = stage(merge_stripes(_scan(read, _stripes(known, upto, packs), PACK), least), "phrase-stripes")
        stripes = made if stripes is None else stripes.unionByName(made)
        known.append(Frequent(_extensions(made), total))
    found = stage(_kept(_extensions(stripes), stripes), "phrase-candidates")
    return _ranked(_scored(found, units, sizes), top)


def _kept(extensions: DataFrame, stripes: DataFrame) -> DataFrame:
    """All candidates, with ``kept`` false where a phrase one word longer, to the right or left, is as frequent.

    Counts never grow with a phrase, so a longer phrase as frequent implies one that is a word longer.
    """
    right = stripes.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("best").alias("more"))
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    left = extensions.select("lang", tail.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("more"))
    most = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    return extensions.join(most, ["lang", "phrase"], "left").select("lang", "phrase", "a", (F.coalesce("more", F.lit(0)) < F.col("a")).alias("kept"))


def _scored(found: DataFrame, units: DataFrame, sizes: DataFrame) -> DataFrame:
    """Kept candidates with the l, r and score of their lowest cut."""
    counts = found.select("lang", "phrase", "a").unionByName(units)
    heads, rests = (counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(n)) for part, n in (("head", "l"), ("rest", "r")))
    parts = F.split("phrase", " ")
    cuts = found.filter("kept").select("lang", "phrase", "a", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), " ").alias("rest"),
    )
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    joined_cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(sizes, "lang")
    scored = joined_cuts.withColumn("over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """Ranks up to ``top``: first within 64 parts of each language, then among what those leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    left = scored.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
