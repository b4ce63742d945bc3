"""Language-model scoring: prediction by partial matching over bytes, with a word baseline.

The byte model gathers contexts of four, two, one and no bytes from the training texts (A-Z lower-cased, each
ended by a stop symbol).  A symbol is predicted in the longest context that has seen it; each context left on
the way costs its escape probability (symbols seen d times in n visits escape with d / (n + d)), and symbols
already seen in a longer context are excluded from shorter ones.  Contexts of four bytes are counted in a table
that grows with the corpus: the most visited ones are looked up in the tasks, all others in a join.  Those of
two bytes have at most 256 * 256 * 257 leaves whatever the corpus holds, so they can be sent to every task.

The baseline counts every training word, over the whole corpus and without a bound: frequent words are
looked up in the tasks, all others in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm.common import crc_remainder, map_batches, raw_bytes
from citylens.session import stage

MODULUS, HELD_OUT = 7, 2
STOP, SYMBOLS = 256, 257
# The stop token of the word baseline; words hold no white space, so it is no word.
END = "\n"
# Words looked up in the tasks: so many of the most frequent ones, each of at most so many bytes.
FREQUENT, FREQUENT_BYTES = 40_000, 32
# Bytes of the longest context, and how many of the most visited contexts are looked up in the tasks, by a hash of so many bits.
LONG, VISITED, HASH_BITS = 4, 1 << 15, 20
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def context_codes(folded: bytes, length: int = 2) -> np.ndarray:
    """Context and symbol of every position as one number; the first contexts are padded with zeros."""
    symbols = np.empty(len(folded) + 1, np.int64)
    symbols[:-1] = np.frombuffer(folded, np.uint8)
    symbols[-1] = STOP
    padded = np.concatenate([np.zeros(length, np.int64), symbols[:-1]])
    contexts = padded[:len(symbols)]
    for k in range(1, length):
        contexts = contexts * 256 + padded[k:k + len(symbols)]
    return contexts * SYMBOLS + symbols


def gather(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training counts: words (word, n) and leaves of contexts of LONG bytes (code, n), both from all training texts."""
    def work(batch: pa.RecordBatch) -> dict | None:
        words: Counter = Counter()
        texts = raw_bytes(batch, "text")
        for text in texts:
            words.update(text.lower().split())
        words[END.encode()] += len(texts)
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        todo, size = [], 0
        for number, text in enumerate(texts):
            todo.append(context_codes(text.lower(), LONG))
            size += len(todo[-1])
            if size > 1 << 21 or number == len(texts) - 1:
                new, n = np.unique(np.concatenate(todo), return_counts=True)
                codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
                todo, size = [], 0
        return {
            "word": [w.decode("utf-8", "replace") for w in words] + [None] * len(codes), "code": [None] * len(words) + codes.tolist(),
            "n": list(words.values()) + counts.tolist(),
        }

    train = docs.filter(crc_remainder("doc_id", MODULUS) != HELD_OUT).select(F.col("text").cast("string"))
    both = stage(map_batches(train, work, "word string, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n")), "lm-counts")
    return both.filter("word IS NOT NULL").select("word", "n"), both.filter("code IS NOT NULL").select("code", "n")


def blend(levels: list[np.ndarray]) -> np.ndarray:
    """Probability of each symbol (row x symbol) by its counts in ever shorter contexts, with escapes and exclusion."""
    out, left, excluded = np.zeros(levels[0].shape), np.ones((len(levels[0]), 1)), np.zeros(levels[0].shape, bool)
    for counts in levels:
        own = np.where(excluded, 0.0, counts)
        seen = own > 0
        total, kinds = own.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        excluded |= seen
        # A context that leaves no symbol has no escape; one without visits passes everything on.
        escape = np.where(excluded.all(axis=1, keepdims=True), 0, kinds)
        visits = np.where(total > 0, total + escape, 1.0)
        out += own * (left / visits)
        left = np.where(total > 0, left * escape / visits, left)
    free = ~excluded
    return out + np.where(free, left / np.maximum(free.sum(axis=1, keepdims=True), 1), 0.0)


def short_counts(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each two-byte context (-1: unseen), counts of each symbol per slot and per last byte."""
    contexts, symbols = codes // SYMBOLS, codes % SYMBOLS
    order1 = np.zeros((256, SYMBOLS))
    np.add.at(order1, (contexts % 256, symbols), counts)
    present, slot = np.unique(contexts, return_inverse=True)
    order2 = np.zeros((len(present), SYMBOLS), np.float32 if counts.max(initial=0) < 1 << 24 else np.float64)
    order2[slot, symbols] = counts
    slots = np.full(65536, -1, np.int32)
    slots[present] = np.arange(len(present), dtype=np.int32)
    return slots, order2, order1


def shorter(contexts: np.ndarray, short: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Counts of each symbol in the contexts of two, one and no bytes that end the given contexts."""
    slots, order2, order1 = short
    place = slots[contexts % 65536]
    two = np.zeros((len(contexts), SYMBOLS))
    two[place >= 0] = order2[place[place >= 0]]
    return [two, order1[contexts % 256], np.broadcast_to(order1.sum(axis=0), two.shape)]


def logs(contexts: np.ndarray, short: tuple, own: Callable[[slice], list[np.ndarray]] = lambda part: []) -> np.ndarray:
    """log10 probability of each symbol per context; ``own`` gives the counts of contexts longer than two bytes."""
    out = np.empty((len(contexts), SYMBOLS), np.float32)
    with np.errstate(divide="ignore"):
        for at in range(0, len(contexts), 1024):
            part = slice(at, at + 1024)
            out[part] = np.log10(blend([*own(part), *shorter(contexts[part], short)]))
    return out


def ppm_table(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each two-byte context (-1: unseen), log10 of each symbol's probability per slot, and for unseen contexts."""
    slots, order2, order1 = short = short_counts(codes, counts)
    with np.errstate(divide="ignore"):
        fallback = np.log10(blend([order1, np.broadcast_to(order1.sum(axis=0), order1.shape)])).astype(np.float32)
    return slots, logs(np.flatnonzero(slots >= 0), short), fallback


def hashed(contexts: np.ndarray) -> np.ndarray:
    return (contexts.astype(np.uint64) * HASH_FACTOR >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def visited_table(codes: np.ndarray, counts: np.ndarray, short: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of contexts by their hash, the contexts at these places (most visited first) and log10 of each symbol's probability.

    Of contexts with the same hash the most visited one is found; the others count as not visited much.
    """
    contexts, back = np.unique(codes // SYMBOLS, return_inverse=True)
    order = np.argsort(-np.bincount(back, counts, len(contexts)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rank, symbols = place[back], codes % SYMBOLS
    by_rank = np.argsort(rank, kind="stable")
    rank, symbols, counts = rank[by_rank], symbols[by_rank], counts[by_rank]

    def own(part: slice) -> list[np.ndarray]:
        low, high = np.searchsorted(rank, [part.start, part.stop])
        found = np.zeros((min(part.stop, len(contexts)) - part.start, SYMBOLS))
        found[rank[low:high] - part.start, symbols[low:high]] = counts[low:high]
        return [found]

    contexts = contexts[order]
    where, first = np.unique(hashed(contexts), return_index=True)
    table = np.zeros(1 << HASH_BITS, np.int32)
    table[where] = first
    return table, contexts, logs(contexts, short, own)


def visited_score(folded: bytes, visited: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """log10 probability of the symbols in contexts of the table, and the codes of all others."""
    table, contexts, rows = visited
    codes = context_codes(folded, LONG)
    if not len(contexts):
        return 0.0, codes
    total, rare = 0.0, []
    for at in range(0, len(codes), 1 << 16):
        part = codes[at:at + (1 << 16)]
        context = part // SYMBOLS
        place = table[hashed(context)]
        known = contexts[place] == context
        total += rows[place[known], (part - context * SYMBOLS)[known]].sum(dtype=np.float64)
        rare.append(part[~known])
    return float(total), np.concatenate(rare)


def rare_parts(rare: DataFrame, contexts: DataFrame, short) -> DataFrame:
    """row and log10 probability of its symbols in contexts that are not in the table; ``rare`` has row, code and k."""
    met = rare.withColumn("context", F.expr(f"code DIV {SYMBOLS}")).join(contexts, "context", "left")
    n = F.element_at("leaves", (F.col("code") % SYMBOLS).cast("int"))
    # What else a context has seen matters only to symbols that it has not seen.
    seen = F.when(n.isNull(), F.map_keys("leaves"))
    read = met.select("row", "code", "k", n.alias("n"), "visits", F.size(F.map_keys("leaves")).alias("kinds"), seen.alias("seen"))

    def work(batch: pa.RecordBatch) -> dict:
        codes = batch.column("code").to_numpy()
        counts, visits, kinds = (np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)) for c in ("n", "visits", "kinds"))
        out = np.zeros(len(codes))
        known = counts > 0
        out[known] = np.log10(counts[known] / (visits + np.where(kinds < SYMBOLS, kinds, 0))[known])
        new = np.flatnonzero(~known)
        for at in range(0, len(new), 1024):
            part = new[at:at + 1024]
            own, chosen = np.zeros((len(part), SYMBOLS)), codes[part] % SYMBOLS
            seen = batch.column("seen").take(pa.array(part)).to_pylist()
            for k, symbols in enumerate(seen):
                # Only which symbols were seen and how often all together decides the escape.
                if symbols:
                    own[k, symbols] = visits[part[k]] / len(symbols)
            out[part] = np.log10(blend([own, *shorter(codes[part] // SYMBOLS, short.value)])[np.arange(len(part)), chosen])
        return {"row": batch.column("row"), "part": out * batch.column("k").to_numpy()}

    return map_batches(read, work, "row long, part double")


def ppm_score(folded: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """log10 probability of a text, its stop symbol included, in contexts of two bytes at most."""
    slots, rows, fallback = table
    total = 0.0
    codes = context_codes(folded)
    for at in range(0, len(codes), 1 << 16):
        part = codes[at:at + (1 << 16)]
        contexts, symbols = part // SYMBOLS, part % SYMBOLS
        place = slots[contexts]
        known = place >= 0
        total += rows[place[known], symbols[known]].sum(dtype=np.float64) + fallback[contexts[~known] % 256, symbols[~known]].sum(dtype=np.float64)
    return float(total)


def _counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The columns code and n of a table of bounded size."""
    found = table.toArrow()
    return found["code"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2.  Null text is empty and has its
    end token only; a null id counts as the empty id.  Each repeated row is scored and counts in
    training.  Without training texts every word is unknown and bytes are equally likely.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    words, leaves = gather(docs)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    grouped = leaves.groupBy(F.expr(f"code DIV {SYMBOLS}").alias("context")).agg(
        F.sum("n").alias("visits"), F.map_from_entries(F.collect_list(F.struct((F.col("code") % SYMBOLS).cast("int"), "n"))).alias("leaves"))
    contexts = stage(grouped, "lm-contexts")
    last = F.expr(f"code DIV {SYMBOLS} % 65536 * {SYMBOLS} + code % {SYMBOLS}")
    counts = _counts(leaves.groupBy(last.alias("code")).agg(F.sum("n").alias("n")))
    two_bytes = spark.sparkContext.broadcast(short_counts(*counts))
    most = contexts.orderBy(F.desc("visits"), "context").limit(VISITED).select("context", F.explode("leaves").alias("symbol", "n"))
    most = _counts(most.select((F.col("context") * SYMBOLS + F.col("symbol")).alias("code"), "n"))
    table = spark.sparkContext.broadcast(visited_table(*most, two_bytes.value))
    short = words.filter(F.octet_length("word") <= FREQUENT_BYTES)
    frequent = spark.sparkContext.broadcast({w.encode(): n for w, n in short.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()})
    base = math.log10(total + kinds + 1)

    def work(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("n_tokens", "known", "part", "score", "rare_codes")}
        common, model = frequent.value, table.value
        # Rare words of all texts in one list, with the place where each text's begin.
        rare, times, starts = [], [], [0]
        for text in raw_bytes(batch, "text"):
            folded = text.lower()
            counts = Counter(folded.split())
            tokens = sum(counts.values()) + 1
            counts[END.encode()] = 1
            known, part = 0, 0.0
            for w, n in counts.items():
                c = common.get(w)
                if c is None:
                    rare.append(w.decode("utf-8", "replace"))
                    times.append(n)
                else:
                    known += n
                    part += n * (math.log10(c + 1) - base)
            out["n_tokens"].append(tokens)
            out["known"].append(known)
            out["part"].append(part)
            score, codes = visited_score(folded, model)
            codes, k = np.unique(codes, return_counts=True)
            out["score"].append(score)
            out["rare_codes"].append([{"code": c, "k": n} for c, n in zip(codes.tolist(), k.tolist())])
            starts.append(len(rare))
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int32())], names=["word", "k"])
        out["rare"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)
        return out | {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")}

    held = (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out")
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held, F.col("text").cast("string"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, rare array<struct<word: string, k: int>>, rare_codes array<struct<code: long, k: int>>"
    scored = stage(map_batches(read, work, schema), "lm-parts")
    # Words outside the table of frequent ones: each (row, word) meets its count, unknown words find none.
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    met = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(base))).alias("rare_part"),
    )
    codes = scored.select("row", F.explode("rare_codes").alias("r")).select("row", "r.code", "r.k")
    long = rare_parts(codes, contexts, two_bytes).groupBy("row").agg(F.sum("part").alias("long_part"))
    return scored.drop("rare", "rare_codes").join(met, "row", "left").join(long, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rare_part", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("long_part", F.lit(0.0))).alias("score"),
    )
