"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and windows of documents are TF-IDF vectors over hashed words.  A randomised SVD of all
passages and items, its product summed in the tasks, gives a latent basis.  Lists of the places of answer words, an item's rarest, say which
windows hold enough of which item's answer; for these pairs the cosine of window and item finds candidates, and a
candidate counts if enough of the item's words appear in the window in order (longest common subsequence).  Items too
short for a telling cosine count as well where they stand word for word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.llm.common import map_batches, pa_schema

# Words are hashed to so many features; passages of BLOCKS_PER_PASSAGE blocks are what idf counts.
FEATURES, BLOCK, BLOCKS_PER_PASSAGE = 1 << 14, 8, 6
# Items longer than this are searched piece by piece.
PIECE = 64
RANK, OVERSAMPLE, SEED = 96, 16, 11
# All passages of documents together weigh in the basis as much as so many, all benchmark pieces as at most so many.
PASSAGES_WEIGH, PIECES_WEIGH = 4_000, 20_000
# Passages are multiplied so many at a time; sums of products travel in so many slices of features.
PASSAGES_AT_ONCE, SLICES = 16, 256
COSINE, IN_ORDER, ANSWER_SHARE = 0.65, 0.6, 0.5
ANSWER_WORDS = 5
# Items below this length are also found where they stand word for word, whatever the cosine.
SHORT = 16
# Marks become spaces, so words carry no punctuation.
PLAIN = bytes(32 if chr(i) in ".,;:!?\"'()[]{}*#$%&|<>-_/\\" else i for i in range(256))
# Documents are cut into runs of so many words (with overlap) and handled so many words at a time.
RUN_WORDS, WORDS_AT_ONCE = 1 << 15, 1 << 15
# Items searched in one pass over the documents.
ITEMS_AT_ONCE = 20_000


# Each byte of a word is multiplied by an odd number of its place; the sum, mixed, is the word's feature.
PLACES = np.random.default_rng(SEED).integers(1 << 31, size=256).astype(np.uint32) * np.uint32(2) + np.uint32(1)
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
# Texts are hashed so many bytes at a time, and taken from a batch so many at a time.
BYTES_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 256


def plain(text: str | None) -> bytes:
    """Lower-case text with spaces for ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Hashed features of the words of each plain text."""
    out, todo, size = [], [], 0
    for text in texts:
        todo.append(text)
        size += len(text) + 1
        if size >= BYTES_AT_ONCE:
            out += _features_of_few(todo)
            todo, size = [], 0
    return out + _features_of_few(todo)


def _features_of_few(texts: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~WHITE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    ends = np.cumsum([len(text) + 1 for text in texts])
    ids = np.empty(0, np.int64)
    if len(starts):
        # Bytes count from the beginning of their word; those between words add nothing.
        own = raw[starts[0]:]
        place = np.arange(len(own), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), np.diff(np.append(starts, len(raw))))
        sums = np.add.reduceat((own + np.uint32(1)) * PLACES[place & 255] * inside[1 + starts[0]:-1], starts - starts[0], dtype=np.uint32)
        ids = (((sums ^ sums >> np.uint32(15)) * PLACES[0]) >> np.uint32(16)).astype(np.int64) % FEATURES
    return np.split(ids, np.searchsorted(starts, ends[:-1])) if texts else []


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, of which only a few are held."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        yield from batch.column("text").slice(at, TEXTS_AT_ONCE).to_pylist()


def read(texts: Iterable[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text, plain, and the features of its words; about BYTES_AT_ONCE of texts are held."""
    todo, size = [], 0
    for text in texts:
        todo.append(plain(text))
        size += len(todo[-1]) + 1
        if size >= BYTES_AT_ONCE:
            yield from zip(todo, features(todo))
            todo, size = [], 0
    yield from zip(todo, features(todo))


class FeatureOf(dict):
    """Hashed feature of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = int(features([word])[0][0])
        return found


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return plain(text).split()


def item_pieces(items: DataFrame) -> list[tuple[int, list[bytes]]]:
    """Pieces (item_id, words) of one block of the benchmark; items without words have none."""
    return [(item, piece) for item, text in items.collect() for piece in cut(plain_words(text))]


def passage_counts(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and word counts (passage x feature) of a few passages at a time; ``texts`` are the features of each text's words.

    No more texts are read than a few passages need, so what is held does not depend on how many there are.
    """
    step, few = BLOCK * BLOCKS_PER_PASSAGE, []
    for ids in texts:
        for at in range(0, len(ids), step):
            few.append(ids[at:at + step])
            if len(few) == PASSAGES_AT_ONCE:
                yield _counted(few)
                few = []
    if few:
        yield _counted(few)


def _counted(few: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, column = np.unique(np.concatenate(few), return_inverse=True)
    cell = np.repeat(np.arange(len(few)), [len(ids) for ids in few]) * len(kinds) + column
    return kinds, np.bincount(cell, minlength=len(few) * len(kinds)).reshape(len(few), -1)


def learn_idf(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse passage frequency of every feature and the number of passages, over all documents.

    Every task counts over all its texts.
    """
    schema = "feature int, n long"
    target = pa_schema(docs.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(FEATURES, np.int64), 0
        for kinds, counts in passage_counts(ids for batch in batches for _, ids in read(texts_of(batch))):
            df[kinds] += (counts > 0).sum(axis=0)
            passages += len(counts)
        if passages:
            found = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *found.tolist()], pa.int32()), pa.array([passages, *df[found].tolist()], pa.int64())], schema=target)

    rows = docs.select(F.col("text").cast("string")).mapInArrow(work, schema).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    counts = dict((r[0], r[1]) for r in rows)
    total = counts.pop(-1, 0)
    idf = np.full(FEATURES, np.log((total + 1) / 1.0), np.float64)
    for feature, n in counts.items():
        idf[feature] = np.log((total + 1) / (n + 1)) + 1e-3
    return idf.astype(np.float32), total


def cut(words: list | np.ndarray) -> list:
    """The words of an item in pieces of about equal length, PIECE at most."""
    size = -(-len(words) // max(1, -(-len(words) // PIECE)))
    return [words[at:at + size] for at in range(0, len(words), max(size, 1))]


def product(texts: DataFrame, q: np.ndarray, idf: np.ndarray, pieces: bool) -> tuple[np.ndarray, int]:
    """A'A q and the number of rows of A: unit-length TF-IDF vectors of all passages of ``texts``, or of the pieces of items.

    Every task sums over all its texts; the sums of the tasks meet slice of features by slice.
    """
    spark, width, schema = texts.sparkSession, q.shape[1], "slice int, n long, part binary"
    shared, target = spark.sparkContext.broadcast((q.astype(np.float32), idf)), pa_schema(spark, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q, idf), out, n = shared.value, np.zeros((FEATURES, width), np.float32), 0
        found = (ids for batch in batches for _, ids in read(texts_of(batch)))
        for kinds, counts in passage_counts((piece for ids in found for piece in cut(ids)) if pieces else found):
            rows = counts.astype(np.float32) * idf[kinds]
            rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
            out[kinds] += rows.T @ (rows @ q[kinds])
            n += len(rows)
        if n:
            parts = [x.tobytes() for x in np.split(out, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(parts, pa.binary())], schema=target)

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(FEATURES // SLICES * width)
        for part in group["part"]:
            total += np.frombuffer(part, np.float32)
        return pd.DataFrame({"slice": [key[0]], "n": [group["n"].sum()], "part": [total.astype(np.float32).tobytes()]})

    total, n = np.zeros((SLICES, FEATURES // SLICES, width)), 0
    for at, n, part in texts.select("text").mapInArrow(work, schema).groupBy("slice").applyInPandas(add, schema).collect():
        total[at] = np.frombuffer(bytes(part), np.float32).reshape(-1, width)
    return total.reshape(FEATURES, width), n


def learn_basis(docs: DataFrame, items: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Latent vectors of all features (FEATURES x RANK) by a randomised SVD of all passages of ``docs`` and all pieces of ``items``.

    Both sides are weighed as wholes.  One product with A'A and its random test vectors are enough for its leading
    eigenvectors (Nystroem); directions that no text has are zero.
    """
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((FEATURES, RANK + OVERSAMPLE)))
    total = np.zeros(q.shape)
    for texts, weigh, pieces in ((docs, PASSAGES_WEIGH, False), (items, PIECES_WEIGH, True)):
        part, n = product(texts.select(F.col("text").cast("string")), q, idf, pieces)
        total += part * min(1.0, weigh / max(n, 1))
    values, turn = np.linalg.eigh((q.T @ total + total.T @ q) / 2)
    real = values > max(values.max(), 0.0) * 1e-6
    vectors, sizes, _ = np.linalg.svd(total @ turn[:, real] / np.sqrt(values[real]), full_matrices=False)
    basis = np.zeros((FEATURES, RANK), np.float32)
    vectors = vectors[:, sizes > 0][:, :RANK]
    basis[:, :vectors.shape[1]] = vectors
    return basis


def in_order(masks: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence; ``masks`` has the places of each word of the item."""
    full = (1 << length) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            both = row & mask
            row = (row + both) | (row - both)
    return length - (row & full).bit_count()


class Search:
    """Items prepared for search; ``leaks`` lists what a batch of texts holds."""

    def __init__(self, pieces: list[tuple[int, list[bytes]]], idf: np.ndarray, basis: np.ndarray):
        self.pieces, self.latent = pieces, idf[:, None] * basis
        self.feature = feature = FeatureOf()
        by_blocks = defaultdict(list)
        self.masks, self.answers = [], []
        postings = []
        for k, (_, words) in enumerate(pieces):
            masks: dict[bytes, int] = {}
            for place, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << place
            self.masks.append(masks)
            self.answers.append(sorted(masks, key=lambda w: (-float(idf[feature[w]]), w))[:ANSWER_WORDS])
            postings += [(feature[w], k, j) for j, w in enumerate(self.answers[k])]
            # A window of so many blocks holds the piece wherever it begins.
            by_blocks[-(-(len(words) + BLOCK - 1) // BLOCK)].append(k)
        # Answer words by feature: those of feature f are ``posted[posts[f]:posts[f + 1]]``, as item and place in its answer.
        postings.sort()
        self.posted = np.array([(k, j) for _, k, j in postings], np.int64).reshape(-1, 2)
        self.posts = np.searchsorted([f for f, _, _ in postings], np.arange(FEATURES + 1))
        self.need = np.array([ANSWER_SHARE * len(answer) for answer in self.answers])
        self.blocks = np.zeros(len(pieces), np.int64)
        self.rows = np.zeros((len(pieces), RANK), np.float32)
        for blocks, members in by_blocks.items():
            rows = np.array([self.latent[[feature[w] for w in pieces[k][1]]].sum(axis=0) for k in members], np.float32)
            self.rows[members] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            self.blocks[members] = blocks
        self.most = max(by_blocks, default=1)

    def leaks(self, texts: Iterable[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text number, piece number, cosine, share in order, share of the answer), best window per pair."""
        found, todo, size = {}, [], 0
        for number, (whole, ids) in enumerate(read(texts)):
            for at in range(0, len(ids), RUN_WORDS):
                run = ids[at:at + RUN_WORDS + BLOCK * self.most]
                todo.append((number, whole, at, run))
                size += len(run)
                if size >= WORDS_AT_ONCE:
                    self._handle(todo, found)
                    todo, size = [], 0
        self._handle(todo, found)
        return [(n, k, *v) for (n, k), v in sorted(found.items())]

    def _likely(self, ids: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (by their first block) and items of which they hold enough of the answer.

        Words look their feature up in the lists of answer words; each hit counts for the windows of its item's
        length that reach over its block, every place of the answer once.
        """
        many = self.posts[ids + 1] - self.posts[ids]
        met = np.flatnonzero(many)
        many = many[met]
        at = np.repeat(self.posts[ids[met]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, place = self.posted[at].T
        hit = np.unique(np.stack([item, np.repeat(block[met], many), place], 1), axis=0) if len(at) else np.empty((0, 3), np.int64)
        reach = self.blocks[hit[:, 0]]
        back = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        item, window, place = np.repeat(hit[:, 0], reach), np.repeat(hit[:, 1], reach) - back, np.repeat(hit[:, 2], reach)
        # One number for window, item and place of the answer; windows may begin before the first block.
        key = np.unique(((window + self.most) * len(self.pieces) + item) * ANSWER_WORDS + place)
        pair, count = np.unique(key // ANSWER_WORDS, return_counts=True)
        window, item = pair // len(self.pieces) - self.most, pair % len(self.pieces)
        enough = (count >= self.need[item]) & (window >= 0)
        return window[enough], item[enough]

    def _handle(self, runs: list[tuple[int, bytes, int, np.ndarray]], found: dict) -> None:
        """Runs are text number, plain text, number of the first word and features; words are cut out only where a window may count."""
        if not runs or not self.pieces:
            return
        ids = np.concatenate([run for *_, run in runs])
        lengths = np.array([len(run) for *_, run in runs])
        blocks = -(-lengths // BLOCK)
        # Each run is followed by empty blocks, so that windows end with it.
        first = np.concatenate([[0], np.cumsum(blocks + self.most)])[:-1]
        word_starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        inside = np.arange(len(ids)) - np.repeat(word_starts, lengths)
        block = np.repeat(first, lengths) + inside // BLOCK
        window, item = self._likely(ids, block)
        r = np.searchsorted(first, window, side="right") - 1
        # A window begins in its own run, not in the empty blocks after another.
        own = window - first[r] < blocks[r]
        window, item, r = window[own], item[own], r[own]
        hits = []
        for begin in range(0, len(window), 4096):
            w, k, run = window[begin:begin + 4096], item[begin:begin + 4096], r[begin:begin + 4096]
            # Words of each window: from its first block on, to the end of its last or of the run.
            start = word_starts[run] + (w - first[run]) * BLOCK
            size = np.minimum(start + self.blocks[k] * BLOCK, word_starts[run] + lengths[run]) - start
            heads = np.cumsum(size) - size
            each = np.repeat(start - heads, size) + np.arange(size.sum())
            sums = np.add.reduceat(self.latent[ids[each]], heads, axis=0, dtype=np.float32)
            cosine = np.einsum("ij,ij->i", sums, self.rows[k]) / np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-9)
            hits += zip(cosine.tolist(), run.tolist(), (w - first[run]).tolist(), k.tolist())
        split = {}
        for cosine, run, begin, k in sorted(hits, reverse=True):
            number, whole, at, own = runs[run]
            item_words = self.pieces[k][1]
            if (number, k) in found or cosine < COSINE and len(item_words) >= SHORT:
                continue
            if number not in split:
                split[number] = whole.split()
            part = split[number][at + begin * BLOCK:at + min((begin + int(self.blocks[k])) * BLOCK, len(own))]
            if cosine < COSINE and not holds(part, item_words):
                continue
            answer = sum(w in part for w in self.answers[k]) / len(self.answers[k])
            if answer < ANSWER_SHARE:
                continue
            length = len(item_words)
            share = in_order(self.masks[k], length, part) / length
            if share >= IN_ORDER:
                found[number, k] = (cosine, share, answer)


def holds(words: list[bytes], part: list[bytes]) -> bool:
    """Whether ``part`` stands in ``words`` without a gap."""
    return b"\n" + b"\n".join(part) + b"\n" in b"\n" + b"\n".join(words) + b"\n"


def prepared(spark: SparkSession, parts: tuple) -> Callable[[], Search]:
    """The search, made from broadcast parts once in every task."""
    shared, made = spark.sparkContext.broadcast(parts), []

    def get() -> Search:
        if not made:
            made.append(Search(*shared.value))
        return made[0]

    return get


def searches(docs: DataFrame, items: DataFrame) -> list[tuple]:
    """What a Search is made of, per ITEMS_AT_ONCE items; statistics and basis are learnt from all documents of ``docs``."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    idf, _ = learn_idf(docs)
    out, basis = [], learn_basis(docs, items, idf)
    for block in range(blocks):
        pieces = item_pieces(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
        out.append((pieces, idf, basis))
    return out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, in_order and answer: one row per document and item found in it.

    Null and wordless texts and items match nothing; repeated documents are listed each time; repeated
    items count once; an empty table on either side gives no rows.  A null id is listed as null.  Items
    longer than PIECE words are found by any of their pieces.  Other columns are ignored.
    """
    found = None
    for parts in searches(docs, items):
        search = prepared(docs.sparkSession, parts)

        def work(batch: pa.RecordBatch, search=search) -> dict | None:
            ids = batch.column("doc_id").to_pylist()
            best: dict = {}
            for number, piece, *scores in search().leaks(texts_of(batch)):
                pair = (number, search().pieces[piece][0])
                best[pair] = max(best.get(pair, (0.0,)), tuple(scores))
            if not best:
                return None
            columns = list(zip(*best.values()))
            return {"doc_id": [ids[n] for n, _ in best], "item_id": [i for _, i in best], "cosine": columns[0], "in_order": columns[1], "answer": columns[2]}

        rows = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, item_id long, cosine double, in_order double, answer double")
        found = rows if found is None else found.unionByName(rows)
    return found


def clean_texts(search: Callable[[], Search]):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        bad = {n for n, *_ in search().leaks(texts)}
        return pd.Series([n not in bad for n in range(len(texts))])

    return clean


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    for parts in searches(docs, items):
        docs = docs.filter(clean_texts(prepared(docs.sparkSession, parts))(F.col("text").cast("string")))
    return docs
