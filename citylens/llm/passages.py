"""Substring deduplication with repeated-phrase automata.

A passage recurs if a window of consecutive words also starts in another document.

1. Marks.  Each window is named by the least hash among its short phrases, so equal windows have equal marks
   and neighbouring windows mostly share one.  Marks seen in two documents are candidates; a bitmap of fixed
   size tells tasks about them (what it lets through by chance is dropped below).
2. Automata.  Consecutive windows of one mark travel as one segment of text to the shard of their mark.  There
   passages that really start in two documents are confirmed, word by word, and compiled into an
   Aho-Corasick automaton per shard, whose values are the smallest documents; all segments of the shard are
   streamed through it, and each gets the smallest document of each of its windows.
3. Occurrences.  All documents are read again; their segments meet those answers, and words covered by a window
   of a smaller document are removed.

Marks that occur too often for one shard are cut into single windows, each its own key, so no task gets more
than a bounded number of different segments for one key; equal segments are merged in each task before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm.bitmaps import Bitmap
from citylens.llm.common import pa_schema
from citylens.llm.words import Words, chunks, joined, read_words
from citylens.session import stage

PHRASE = 5  # words of the phrases that windows are named by
PART_BYTES = 2 << 20  # text that is taken apart at once: the arrays of its words take some 50 bytes a byte of text
MERGE_BYTES = 12 << 20  # segments among which equal ones are merged before they move
BITMAP_BITS = 27  # 16 MB for candidates, 16 MB for frequent marks, however many there are
FREQUENT_MARK = 50_000  # occurrences from which the windows of a mark are keyed one by one
SHARD_WINDOWS = 20_000  # different windows from which a shard is closed (at the end of a key)
NEVER = np.iinfo(np.int64).max
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def marks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and their marks."""
    first = words.first
    per_text = np.maximum(words.counts - window + 1, 0)
    total = int(per_text.sum())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.arange(total) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per_text)[:-1]]), per_text)
    names = np.fromiter(map(xxhash.xxh64_intdigest, words.names.to_pylist()), np.uint64, len(words.names))
    size = min(PHRASE, window)
    each = names[words.codes]
    short = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        short = short * _MIX[0] + each[k:len(each) - size + 1 + k]
    short = (short ^ short >> np.uint64(31)) * _MIX[1]
    # Least of the next ``wide`` values, by doubling.
    wide, least, reach = window - size + 1, short, 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    # Least values crowd near zero; a bijection spreads them over all slots.
    return starts, (least * _MIX[0])[starts]


def _window_marks(docs: DataFrame, window: int) -> DataFrame:
    """mark, low, high (smallest and largest document) and n (occurrences), summed within chunks."""
    schema = "mark long, low long, high long, n long"
    target = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=PART_BYTES):
            words = read_words(chunk.column("text"))
            starts, found = marks(words, window)
            if not len(starts):
                continue
            text_of = np.searchsorted(words.first, starts, "right") - 1
            head = np.ones(len(starts), bool)
            head[1:] = (found[1:] != found[:-1]) | (text_of[1:] != text_of[:-1])
            ids = chunk.column("id").to_numpy()[text_of[head]]
            found = found[head]
            order = np.argsort(found)
            found, ids = found[order], ids[order]
            edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            counts = np.diff(np.append(edge, len(found)))
            columns = (found[edge].view(np.int64), np.minimum.reduceat(ids, edge), np.maximum.reduceat(ids, edge), counts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=target)

    return docs.select("id", "text").mapInArrow(run, schema)


def _segments(chunk: pa.RecordBatch, window: int, candidates: Bitmap, frequent: Bitmap) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, pa.Array] | None:
    """Candidate segments of a chunk: words, first word, number of windows, key and text of each."""
    words = read_words(chunk.column("text"))
    starts, found = marks(words, window)
    picked = candidates.contains(found) if len(found) else np.empty(0, bool)
    starts, found = starts[picked], found[picked]
    if not len(starts):
        return None
    alone = frequent.contains(found)
    head = np.ones(len(starts), bool)
    # Windows of two texts never stand next to each other: the last window of a text ends with it.
    head[1:] = (found[1:] != found[:-1]) | (starts[1:] != starts[:-1] + 1) | alone[1:]
    at = np.flatnonzero(head)
    windows = np.diff(np.append(at, len(starts)))
    begin, keys, alone = starts[at], found[at].view(np.int64).copy(), alone[at]
    lengths = windows + window - 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], lengths)
    texts = joined(words.names, words.codes[places], lengths)
    for n in np.flatnonzero(alone):
        keys[n] = np.uint64(xxhash.xxh64_intdigest(texts[int(n)].as_py())).astype(np.int64)
    return words, begin, windows, keys, texts


def _keyed_segments(docs: DataFrame, window: int, candidates: Bitmap, frequent: Bitmap) -> DataFrame:
    schema = "key long, words string, low long, high long"
    target = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by(["key", "words"], use_threads=False).aggregate([("id", "min"), ("id", "max")])
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([batch.column(n).cast(f.type) for n, f in zip(("key", "words", "id_min", "id_max"), target)], schema=target)

        for chunk in chunks(batches, limit=PART_BYTES):
            found = _segments(chunk, window, candidates, frequent)
            if found is None:
                continue
            words, begin, _, keys, texts = found
            ids = chunk.column("id").to_numpy()[np.searchsorted(words.first, begin, "right") - 1]
            held.append(pa.table({"key": keys, "words": texts, "id": ids}))
            if sum(table.nbytes for table in held) >= MERGE_BYTES:
                yield from merged()
                held.clear()
        if held:
            yield from merged()

    return docs.select("id", "text").mapInArrow(run, schema)


class Letters(dict):
    """A character for each word, so that an automaton moves word by word."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = made = chr(n if n < 0xD800 else n + 0x800)
        return made


def _answer(segments: list[tuple[bytes, int, int]], window: int) -> Iterator[tuple[bytes, list[int]]]:
    """Digest and smallest document per window of the segments of one shard that have something to remove.

    ``segments`` are different texts with their smallest and largest document.  Confirmed passages, those that start in two
    documents, are compiled: segments as a whole, and windows that stand in several of them.  Then every
    segment is streamed through the automaton.
    """
    letter = Letters().__getitem__
    spelled = ["".join(map(letter, text.split(b" "))) for text, _, _ in segments]
    # Per window: smallest document, whether several documents have it, and whether several segments do.
    low: dict[str, int] = {}
    several, shared = set(), set()
    for line, (_, least, most) in zip(spelled, segments):
        for i in range(len(line) - window + 1):
            phrase = line[i:i + window]
            known = low.get(phrase)
            if known is None:
                low[phrase] = least
                if most > least:
                    several.add(phrase)
                continue
            shared.add(phrase)
            if most > least or known != least:
                several.add(phrase)
                if least < known:
                    low[phrase] = least
    automaton = ahocorasick.Automaton()
    for line, (_, least, most) in zip(spelled, segments):
        if least < most:
            automaton.add_word(line, (len(line), least))
    for phrase in shared & several:
        automaton.add_word(phrase, (window, low[phrase]))
    if not len(automaton):
        return
    automaton.make_automaton()
    for line, (text, _, most) in zip(spelled, segments):
        smallest = [NEVER] * (len(line) - window + 1)
        for end, (length, least) in automaton.iter(line):
            for at in range(end - length + 1, end - window + 2):
                if least < smallest[at]:
                    smallest[at] = least
        if min(smallest) < most:
            yield xxhash.xxh3_128_digest(text), smallest


def _answers(segments: DataFrame, window: int) -> DataFrame:
    schema = "segment binary, smallest array<long>"
    target = pa_schema(segments.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[bytes, int, int]] = []
        windows, open_key = 0, None

        def answered() -> Iterator[pa.RecordBatch]:
            rows = list(_answer(shard, window))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

        for batch in batches:
            texts = batch.column("words").cast(pa.binary() if pa.types.is_string(batch.column("words").type) else pa.large_binary())
            for key, text, low, high in zip(batch.column("key").to_pylist(), texts.to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                if key != open_key:
                    if windows >= SHARD_WINDOWS:
                        yield from answered()
                        shard, windows = [], 0
                    open_key = key
                if shard and shard[-1][0] == text:
                    _, least, most = shard[-1]
                    shard[-1] = (text, min(low, least), max(high, most))
                else:
                    shard.append((text, low, high))
                    windows += text.count(b" ") + 2 - window
        yield from answered()

    return segments.repartition("key").sortWithinPartitions("key", "words").mapInArrow(run, schema)


def _occurrences(docs: DataFrame, window: int, candidates: Bitmap, frequent: Bitmap) -> DataFrame:
    schema = "segment binary, id long, text_key long, start long"
    target = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=PART_BYTES):
            found = _segments(chunk, window, candidates, frequent)
            if found is None:
                continue
            words, begin, _, _, texts = found
            text_of = np.searchsorted(words.first, begin, "right") - 1
            named = pa.array(list(map(xxhash.xxh3_128_digest, texts.to_pylist())), pa.binary())
            rows = pa.array(text_of)
            yield pa.RecordBatch.from_arrays([named, chunk.column("id").take(rows), chunk.column("text_key").take(rows), pa.array(begin - words.first[text_of])], schema=target)

    return docs.select("id", "text_key", "text").mapInArrow(run, schema)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Remove the words of the listed windows; see ``drop_passages``."""
    schema = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"
    target = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=PART_BYTES):
            words = read_words(chunk.column("text"))
            first = words.first
            lists = chunk.column("starts")
            starts = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            begin = starts + np.repeat(first[:-1], lengths)
            depth = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + window, -1)
            gone = np.cumsum(depth)[:-1] > 0
            text_of = np.repeat(np.arange(chunk.num_rows), words.counts)
            kept = joined(words.names, words.codes[~gone], np.bincount(text_of[~gone], minlength=chunk.num_rows))
            # Spans of removed words; a span never runs over the end of a text.
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[first[:-1][words.counts > 0]] = gone[first[:-1][words.counts > 0]]
            stop = gone.copy()
            stop[:-1] &= ~gone[1:]
            stop[first[1:][words.counts > 0] - 1] = gone[first[1:][words.counts > 0] - 1]
            opened, closed = np.flatnonzero(edge), np.flatnonzero(stop) + 1
            spans = pa.StructArray.from_arrays([pa.array(x - first[text_of[opened]]) for x in (opened, closed)], ["start", "end"])
            bounds = np.concatenate([[0], np.cumsum(np.bincount(text_of[opened], minlength=chunk.num_rows))]).astype(np.int32)
            made = [chunk.column("doc_id"), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(bounds), spans), kept.cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, target)], schema=target)

    return docs.select("doc_id", "text", "starts").mapInArrow(run, schema)


def drop_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove each word covered by ``window`` words that also start, in the same order, in a smaller doc_id.

    Returns doc_id, n_words, removed (spans of word numbers from 0, end exclusive) and kept (the other words joined by
    one space), one row per row of ``docs``.  Words are separated by ASCII white space and compared as they are; windows are judged
    on the input.  Null text has no words; a null doc_id is smaller than any other; rows that share a doc_id do not remove
    each other's words; repeated rows come back as often as they went in; texts of any length are read whole; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # The smallest long stands for a missing id.
    read = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.expr("-9223372036854775807L - 1")).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    seen = _window_marks(read, window).groupBy("mark").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    shared = stage(seen.filter("low < high").select("mark", "n"), "passage-marks")
    candidates, frequent = Bitmap(shared, BITMAP_BITS), Bitmap(shared.filter(F.col("n") > FREQUENT_MARK), BITMAP_BITS)
    answers = stage(_answers(_keyed_segments(read, window, candidates, frequent), window), "passage-answers")
    met = _occurrences(read, window, candidates, frequent).join(answers, "segment")
    numbered = F.transform("smallest", lambda least, k: F.when(least < F.col("id"), F.col("start") + k))
    found = met.select("id", "text_key", F.filter(numbered, lambda s: s.isNotNull()).alias("starts")).filter(F.size("starts") > 0)
    starts = found.groupBy("id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return _cut(read.join(starts, ["id", "text_key"], "left"), window)
