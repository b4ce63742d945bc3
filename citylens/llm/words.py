"""Words of many texts at once, as numbers: the shared reader of the operators on word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text that is taken apart at once; a single longer text is taken alone.
CHUNK_BYTES = 12 << 20

_WORD, _GAP, _BREAK = 0, 1, 2
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def separators(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """Kind of each byte: gaps end a word, breaks end a word and its piece of text.  All are ASCII, so UTF-8 stays whole."""
    kinds = np.full(256, _WORD, np.uint8)
    kinds[list(gaps)] = _GAP
    kinds[list(breaks)] = _BREAK
    return kinds


WHITE = separators(b" \t\n\r\v\f")


@dataclass
class Words:
    """Words of a chunk in order: ``names[codes[i]]`` is word i; ``counts`` has the words of each text."""

    codes: np.ndarray
    names: pa.Array
    counts: np.ndarray
    follows: np.ndarray  # word i stands in the same piece as word i - 1

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def read_words(texts: pa.Array, kinds: np.ndarray = WHITE, fold: bool = False) -> Words:
    """Take apart the texts of an Arrow column (null: no words); ``fold`` lower-cases A-Z."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    begins = offsets[:-1] - offsets[0]
    inside = begins < len(data)
    kind = kinds[data]
    word = kind == _WORD
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[begins[inside]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return Words(np.empty(0, np.int32), pa.array([], pa.binary()), np.zeros(len(texts), np.int64), np.empty(0, bool))
    body = data[word]
    if fold:
        body = _FOLDED[body]
    # Words are put end to end; each begins after as many word bytes as stand before its start.
    ends_at = np.cumsum(word, dtype=np.int64)
    where = np.append(ends_at[starts] - 1, len(body)).astype(np.int64)
    joined = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(body))])
    coded = joined.dictionary_encode()
    bounds = np.searchsorted(starts, np.append(begins, len(data)))
    follows = np.ones(len(starts), bool)
    follows[bounds[:-1][np.diff(bounds) > 0]] = False
    stops = np.flatnonzero(kind == _BREAK)
    if len(stops):
        passed = np.searchsorted(stops, starts)
        follows[1:] &= passed[1:] == passed[:-1]
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()), np.diff(bounds), follows)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def joined(names: pa.Array, codes: np.ndarray, lengths: np.ndarray, separator: bytes = b" ") -> pa.Array:
    """Consecutive ``lengths`` of ``codes`` as texts of names with a separator between."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), names.take(pa.array(codes)))
    return pa.compute.binary_join(lists, separator)
