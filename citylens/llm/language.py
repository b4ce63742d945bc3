"""Language identification by blended-spectrum string kernels.

A text is the set of character n-grams (n = 1 to 3) of its letters; the kernel of two texts is the number
of n-grams they share, over the root of the product of their numbers.  Landmark texts span the Nyström
features, one-versus-rest kernel ridge regression learns a weight per landmark and language, and all
texts are scored in batches by matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm.common import crc_remainder, map_batches
from citylens.session import stage

MODULUS, HELD_OUT = 4, 2
ORDERS = (1, 2, 3)
# N-grams are hashed to so many columns.
COLUMNS = 1 << 15
# The classifier is fitted on bounded samples, drawn by hash order: texts per language for the regression, and landmarks per language.
FIT_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 1000, 32
RIDGE = 1e-2
UNKNOWN = "und"
BATCH_CELLS = 1 << 24


def letter_codes(text: str) -> np.ndarray:
    """Lower-case code points; every run of other characters becomes one space, at both ends too."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    top = int(points.max()) + 1 if len(points) else 1
    letters = np.array([chr(p).isalpha() for p in range(top)]) if top <= 1024 else None
    if letters is None:
        kinds, back = np.unique(points, return_inverse=True)
        mask = np.array([chr(p).isalpha() for p in kinds])[back]
    else:
        mask = letters[points]
    spaced = np.where(mask, points, 32)
    keep = np.ones(len(spaced), bool)
    keep[1:] = mask[1:] | mask[:-1]
    return np.concatenate([[32], spaced[keep], [32]]).astype(np.uint64)


def gram_columns(text: str) -> np.ndarray:
    """Distinct n-gram columns of a whole text; none if it has no letter."""
    codes = letter_codes(text)
    if not (codes != 32).any():
        return np.empty(0, np.int64)
    found = np.zeros(COLUMNS, bool)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            value = np.full(max(0, len(codes) - n + 1), n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - n + 1 + k] + np.uint64(1)
            found[((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % COLUMNS] = True
    return np.flatnonzero(found)


def presence(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of ones at present columns, scaled so that a product of two is the kernel."""
    out = np.zeros((len(sets), COLUMNS), np.float32)
    for row, columns in zip(out, sets):
        if len(columns):
            row[columns] = 1 / np.sqrt(len(columns))
    return out


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and a weight per column and language, from the training rows.

    The number of languages is that of the labels; the samples per language are bounded.  The matrices of
    the regression are summed in the tasks, so no sample leaves them but the landmarks.
    """
    train = docs.filter((crc_remainder("doc_id", MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = sorted(train.groupBy("lang").count().collect())
    languages = [r[0] for r in sizes]
    if not languages:
        return [], np.zeros((COLUMNS + 1, 0), np.float32)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    share = lambda bound: F.coalesce(*[F.when(F.col("lang") == r[0], F.lit(min(1.0, bound / r[1]))) for r in sizes])
    fit = stage(train.filter(place < share(FIT_PER_LANGUAGE) * 1_000_003).select("lang", "text", place.alias("place")), "language-sample")
    drawn = fit.filter(F.col("place") < share(LANDMARKS_PER_LANGUAGE) * 1_000_003).select("text")
    # A sample of hash order can be empty for a language with few rows; then the whole fit sample is small.
    marks = map_batches(drawn, lambda b: {"columns": [gram_columns(t).tolist() for t in b.column("text").to_pylist()]}, "columns array<long>")
    sets = [np.array(r[0], np.int64) for r in marks.collect()] or [np.arange(1)]
    landmarks = presence(sets)
    kernel = landmarks @ landmarks.T
    values, vectors = np.linalg.eigh(kernel.astype(np.float64))
    good = values > 1e-6 * values.max()
    # Nyström map: features of x are k(x, landmarks) @ root.
    project = landmarks.T @ (vectors[:, good] / np.sqrt(values[good]))
    shared = docs.sparkSession.sparkContext.broadcast(project.astype(np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    width, kinds = project.shape[1] + 1, len(languages)

    def sums(batch: pa.RecordBatch) -> dict:
        gram, cross = np.zeros((width, width)), np.zeros((width, kinds))
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for at in range(0, len(texts), 256):
            x = presence([gram_columns(t) for t in texts[at:at + 256]]) @ shared.value
            x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
            y = np.full((len(x), kinds), -1.0)
            y[np.arange(len(x)), [number[v] for v in langs[at:at + 256]]] = 1.0
            weight = np.array([1 / min(FIT_PER_LANGUAGE, sizes[number[v]][1]) for v in langs[at:at + 256]])[:, None]
            gram += x.T @ (x * weight)
            cross += x.T @ (y * weight)
        return {"row": list(range(width)), "gram": [np.concatenate([g, c]).tolist() for g, c in zip(gram, cross)]}

    parts = map_batches(fit.select("lang", "text"), sums, "row int, gram array<double>")
    added = parts.select("row", F.posexplode("gram").alias("column", "v")).groupBy("row", "column").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((width, width + kinds))
    total[added["row"], added["column"]] = added["v"]
    weights = np.linalg.solve(total[:, :width] + RIDGE * np.eye(width), total[:, width:])
    return languages, np.vstack([project @ weights[:-1], weights[-1:]]).astype(np.float32)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) for each row.

    Only text and language of training rows are learnt from, and only the text is used to predict.  Null
    text and text without a letter are ``und`` with score 0, as is everything if nothing can be learnt.
    Ties go to the first language by name.  A null id counts as the empty id; other columns are ignored.
    """
    languages, weights = learn(docs)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> dict:
        names, scores = [], []
        texts = batch.column("text").to_pylist()
        step = max(1, BATCH_CELLS // COLUMNS)
        for at in range(0, len(texts), step):
            sets = [gram_columns(t or "") for t in texts[at:at + step]]
            margins = presence(sets) @ model.value[:-1] + model.value[-1]
            for columns, row in zip(sets, margins):
                if not len(columns) or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                odds = np.exp(4.0 * (row.astype(np.float64) - row[best]))
                names.append(languages[best])
                scores.append(float(odds[best] / odds.sum()))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

    held = (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out")
    return map_batches(docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")), work, "doc_id long, held_out boolean, lang_pred string, score double")
