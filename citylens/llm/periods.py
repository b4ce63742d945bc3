"""Periodic runs of words by suffix trees.

A run is a stretch of words with a smallest period that no neighbouring word extends.  The smallest period of a run shows
as a Lyndon word: for one of the two orders of the words, the longest Lyndon word that starts somewhere in the
run is exactly one period long.  So the candidates are the longest Lyndon words at every position, for both
orders, and each is extended to the right and to the left as far as the period holds.  Extensions are longest
common prefixes of two suffixes of the text, or of its reversal: the depth of the lowest common
ancestor of two leaves of a suffix tree, which a range minimum over the Euler tour of the leaves answers in constant time.

Trees are built only where runs can be.  In a run of length L and period q, from its (q + 1)th word on, every
word was last seen at most q words before, and these are at least L - q words in a row.  Stretches without that
property are cut until nothing changes, which loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm.common import pa_schema
from citylens.llm.words import Words, chunks, joined, read_words


class SuffixTree:
    """Ukkonen's construction over numbers; a final -1, smaller than all, ends the text."""

    def __init__(self, text: list[int]):
        self.text = text = [*text, -1]
        size = len(text)
        begin, stop, link = [0], [0], [0]
        kids: list[dict[int, int] | None] = [{}]
        suffix = [-1]
        node = edge = length = rest = 0
        for i, symbol in enumerate(text):
            rest += 1
            waiting = 0
            while rest:
                if not length:
                    edge = i
                below = kids[node]
                child = below.get(text[edge])
                if child is None:
                    below[text[edge]] = len(begin)
                    begin.append(i), stop.append(size), link.append(0), kids.append(None), suffix.append(i - rest + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    start = begin[child]
                    span = (i + 1 if kids[child] is None else stop[child]) - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[start + length] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(begin)
                    below[text[edge]] = middle
                    begin.append(start), stop.append(start + length), link.append(0), suffix.append(-1)
                    kids.append({symbol: middle + 1, text[start + length]: child})
                    begin.append(i), stop.append(size), link.append(0), kids.append(None), suffix.append(i - rest + 1)
                    begin[child] = start + length
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                rest -= 1
                if not node and length:
                    length -= 1
                    edge = i - rest + 1
                else:
                    node = link[node]
        self.begin, self.stop, self.kids, self.suffix = begin, stop, kids, suffix

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Leaves (as places of suffixes) in order of an Euler tour, and the depth of the ancestor each shares with the one before.

        ``falling`` visits larger symbols first, the end still before all.
        """
        begin, stop, kids, suffix = self.begin, self.stop, self.kids, self.suffix
        leaves, shared = [], []
        stack = [(0, 0, 0)]
        while stack:
            node, above, depth = stack.pop()
            below = kids[node]
            if below is None:
                leaves.append(suffix[node])
                shared.append(above)
                continue
            depth += stop[node] - begin[node]
            symbols = sorted(below, reverse=not falling)
            if falling and symbols[0] == -1:
                symbols.append(symbols.pop(0))
            # The last on the stack is visited first and shares what its parent shares.
            stack.extend([(below[s], depth, depth) for s in symbols[:-1]])
            stack.append((below[symbols[-1]], above, depth))
        return np.array(leaves, np.int64), np.array(shared, np.int32)


class CommonPrefix:
    """Longest common prefixes of suffixes: range minima over the tour of the leaves."""

    def __init__(self, leaves: np.ndarray, shared: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.levels = [shared]
        while 2 << len(self.levels) - 1 <= len(leaves):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def lengths(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        low, high = self.rank[one], self.rank[other]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place, the next place of smaller rank: there its longest Lyndon word ends."""
    out, open_places = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_places and rank[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return out


def runs(text: list[int], least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of all runs with length >= max(least, times * period), by start, then period."""
    size = len(text)
    tree = SuffixTree(text)
    leaves, shared = tree.tour()
    forward = CommonPrefix(leaves, shared)
    other = np.empty(size + 1, np.int64)
    other[tree.tour(falling=True)[0]] = np.arange(size + 1)
    del tree
    place = np.arange(size)
    ends = np.stack([np.array(next_smaller(rank.tolist())[:size]) for rank in (forward.rank, other)])
    begin, end = np.tile(place, 2), ends.ravel()
    fits = (end - begin) * times <= size
    begin, end = begin[fits], end[fits]
    right = forward.lengths(begin, end)
    del forward
    backward = CommonPrefix(*SuffixTree(text[::-1]).tour())
    left = backward.lengths(size - begin, size - end)
    period, start = end - begin, begin - left
    length = end + right - start
    good = (length >= least) & (length >= times * period)
    found = np.stack([start[good], period[good], length[good]], 1)
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def regions(words: Words, least: int, times: int) -> np.ndarray:
    """Rows (text, begin, end) of the stretches of words outside which no run lies, with a margin of a word."""
    shortest = -(-least * (times - 1) // times)
    size, first = len(words.codes), words.first
    text_of = np.repeat(np.arange(len(words.counts)), words.counts)
    order = np.argsort(text_of * np.int64(len(words.names) + 1) + words.codes, kind="stable")
    back = np.full(size, size + 1, np.int64)
    same = (text_of[order[1:]] == text_of[order[:-1]]) & (words.codes[order[1:]] == words.codes[order[:-1]])
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    long = words.counts >= least
    begin, end = first[:-1][long], first[1:][long]
    while len(begin):
        lengths = end - begin
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], lengths)
        near = back[places] * (times - 1) <= np.repeat(lengths, lengths)
        opens, closes = near.copy(), near.copy()
        opens[1:] &= ~near[:-1]
        opens[bounds[:-1]] = near[bounds[:-1]]
        closes[:-1] &= ~near[1:]
        closes[bounds[1:] - 1] = near[bounds[1:] - 1]
        made_begin, made_end = places[opens], places[closes] + 1
        kept = made_end - made_begin >= shortest
        made_begin, made_end = made_begin[kept], made_end[kept]
        if len(made_begin) == len(begin) and (made_begin == begin).all() and (made_end == end).all():
            break
        begin, end = made_begin, made_end
    of = text_of[begin] if len(begin) else np.empty(0, np.int64)
    begin, end = np.maximum(first[of], begin - (end - begin) // (times - 1) - 1), np.minimum(first[of + 1], end + 1)
    # Stretches that touch or overlap become one; they are sorted by their end.
    if len(begin):
        reach = np.minimum.accumulate(begin[::-1])[::-1]
        apart = np.append(True, (reach[1:] > end[:-1]) | (of[1:] != of[:-1]))
        at = np.flatnonzero(apart)
        of, begin, end = of[at], reach[at], end[np.append(at[1:], len(end)) - 1]
        begin = np.maximum(begin, first[of])
    return np.stack([of, begin, end], 1) if len(begin) else np.empty((0, 3), np.int64)


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """All runs of each text, and the text without their repetitions.

    Returns doc_id, runs (array of start, length and period in words, by start, then period; words count from 0) and
    collapsed (the words that no run holds after its first period, joined by one space), one row per row of
    ``docs``.  A run has length >= max(least, times * period); ``times`` is 2 or more.  Words are separated by ASCII white space and
    compared as they are.  Null and blank texts have no runs and an empty text; ids, null ones too, are passed on; repeated
    rows come back as often as they went in; texts of any length are read whole, each by one task, which holds its trees; an
    empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    target = pa_schema(docs.sparkSession, schema)

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words = read_words(chunk.column("text"))
        first = words.first
        kept = np.ones(len(words.codes), bool)
        found, owner = [np.empty((0, 3), np.int64)], [np.empty(0, np.int64)]
        for text, begin, end in regions(words, least, times).tolist():
            made = runs(words.codes[begin:end].tolist(), least, times)
            # What touches a cut that is no end of the text is part of something longer, which lies in another region.
            cut_left, cut_right = begin > first[text], end < first[text + 1]
            made = made[~((made[:, 0] == 0) & cut_left) & ~((made[:, 0] + made[:, 1] == end - begin) & cut_right)]
            for start, length, period in made.tolist():
                kept[begin + start + period:begin + start + length] = False
            made[:, 0] += begin - first[text]
            found.append(made)
            owner.append(np.full(len(made), text))
        rows, owner = np.concatenate(found), np.concatenate(owner)
        text_of = np.repeat(np.arange(chunk.num_rows), words.counts)
        collapsed = joined(words.names, words.codes[kept], np.bincount(text_of[kept], minlength=chunk.num_rows))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=chunk.num_rows))]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        made = [chunk.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), structs), collapsed.cast(pa.large_string())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield work(chunk)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
