"""Quality classifier by hierarchical empirical Bayes.

Two judgements per document, low quality and toxic.  A document's evidence is a sum of log likelihood
ratios of its words and its shape, each shrunk toward the overall rate.  Its prior is the posterior of the
site it comes from: paths shrink toward their host, hosts toward the global rate, the less the more
documents they have and the more sites differ.  Site counts are grouped sums over all documents, labels
where there are any and the classifier's own probabilities elsewhere.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.llm.common import map_batches, raw_bytes
from citylens.session import stage

TARGETS = ("low", "toxic")
# The document classifier is fitted on about so many labelled rows at most, drawn by hash order.
FIT_ROWS = 20_000
# Words count as evidence from this many standard errors, this many documents and this share of the rejected
# documents on, so that no chance and no single group of copies makes one; so many are kept.
MIN_Z, MIN_DOCUMENTS, MIN_REACH, MAX_WORDS = 5.0, 5, 0.015, 5_000
# They must be this much likelier (natural log) in one class; their absence counts if this share of a class has them.
MIN_RATIO, MIN_SHARE = 2.0, 0.05
# Documents at the overall rate that are added to every count.
PSEUDO = 10.0
EDGES = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
LENGTH_EDGES = (0.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0)
# Stems are the first bytes of longer words.
STEMS = (4, 5)
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
SIGNS = b"!#$%&*|<>{}[]^~@_=+\\/"
EDGE_SIGNS = b".,;:!?\"'()[]*#$%&|"


def traits(text: bytes) -> list[tuple[str, object]]:
    """Features of a whole text: its distinct words without edge signs, their stems, and binned shape figures."""
    words = text.lower().split()
    if not words:
        return [("empty", 1)]
    rate = lambda signs: 1 - len(text.translate(None, signs)) / len(text)
    letters = rate(LETTERS)
    kinds = {w.strip(EDGE_SIGNS) for w in set(words)}
    stems = {b"^" + w[:n] for w in kinds for n in STEMS if len(w) > n}
    return [("word", w) for w in kinds | stems] + [
        ("upper", bisect_right(EDGES, rate(UPPER) / letters if letters else 0.0)), ("signs", bisect_right(EDGES, rate(SIGNS))),
        ("repeats", bisect_right(EDGES, sum(map(eq, words, words[1:])) / len(words))), ("length", bisect_right(LENGTH_EDGES, len(text) / len(words))),
    ]


def clean_labels(labels: DataFrame) -> DataFrame:
    """doc_id, low and toxic (0 or 1): rows without id or label are left out, the worse of several wins."""
    known = labels.dropna(subset=["doc_id", "quality", "toxic"])
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))


def learn_evidence(docs: DataFrame, labels: DataFrame) -> dict:
    """Log likelihood ratios of features for each target, from a bounded sample of labelled rows."""
    total = labels.count()
    sample = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, FIT_ROWS / max(total, 1)) * 1_000_003)

    def work(batch: pa.RecordBatch) -> dict:
        counts: Counter = Counter()
        for text, low, toxic in zip(raw_bytes(batch, "text"), batch.column("low").to_pylist(), batch.column("toxic").to_pylist()):
            counts.update((kind, value, low, toxic) for kind, value in [*traits(text), ("all", 1)])
        keys = [(k, v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), lo, tx) for k, v, lo, tx in counts]
        return dict(zip(("kind", "value", "low", "toxic"), zip(*keys))) | {"n": list(counts.values())}

    # The sample is bounded by FIT_ROWS, so it may be sent to every task.
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(sample.select("doc_id")), "doc_id")
    # Copies are no independent evidence: of rows with the same distinct words one is learnt from.
    digest = F.xxhash64(F.array_sort(F.array_distinct(F.split(F.lower("text"), r"\s+"))))
    single = drawn.select("doc_id", digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    sample = stage(sample.join(single.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-sample")
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    rows = map_batches(labelled, work, "kind string, value string, low int, toxic int, n long").groupBy("kind", "value").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(t)).alias(t) for t in TARGETS])
    rows = stage(rows, "quality-features")
    every = rows.filter("kind = 'all'").first()
    model: dict = {"prior": {}, "words": {}, "shapes": {}, "absent": dict.fromkeys(TARGETS, 0.0)}
    for target in TARGETS:
        n = every["n"] if every else 0
        bad = every[target] if every else 0
        # Without labels nothing speaks against a document.
        p = (bad + 1) / (n + 2) if n else 1e-3
        model["prior"][target] = p
        if not bad or bad == n:
            continue
        error = F.sqrt(F.col("n") * p * (1 - p))
        z = F.abs(F.col(target) - F.col("n") * p) / error
        words = rows.filter((F.col("kind") == "word") & (F.col("n") >= max(MIN_DOCUMENTS, MIN_REACH * bad)) & (z >= MIN_Z)).orderBy(z.desc(), "value").limit(MAX_WORDS)
        model["absent"][target] = 0.0
        for r in [*words.collect(), *rows.filter("kind NOT IN ('word', 'all')").collect()]:
            # Pseudo documents in proportion to how common the feature is.
            share = min(r["n"] / n, 0.99)
            there = (r[target] + PSEUDO * share) / (bad + PSEUDO)
            elsewhere = (r["n"] - r[target] + PSEUDO * share) / (n - bad + PSEUDO)
            ratio = math.log(there / elsewhere)
            if r["kind"] == "word":
                # Words that are common to both classes come in passages and copies, not as independent evidence.
                if abs(ratio) < MIN_RATIO:
                    continue
                # A frequent word speaks by its absence too.
                absent = math.log((1 - there) / (1 - elsewhere)) if max(there, elsewhere) >= MIN_SHARE else 0.0
                model["absent"][target] += absent
                model["words"].setdefault(r["value"].encode(), {})[target] = ratio - absent
            else:
                model["shapes"].setdefault((r["kind"], r["value"]), {})[target] = ratio
    return model


def evidence(text: bytes, model: dict) -> list[float]:
    """Log likelihood ratio of each target."""
    out = dict(model["absent"])
    for kind, value in traits(text):
        found = model["words"].get(value) if kind == "word" else model["shapes"].get((kind, str(value)))
        for target, ratio in (found or {}).items():
            out[target] += ratio
    return [out[t] for t in TARGETS]


def site_priors(judged: DataFrame, levels: list[str]) -> DataFrame:
    """Posterior rate of each target per path: ``judged`` has the level columns and 0..1 per target.

    Levels go from host to path.  Strengths are estimated by moments: single figures per level.
    """
    sums = stage(judged.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS]), "quality-sites")
    whole = sums.agg(F.sum("n"), *[F.sum(t) for t in TARGETS]).first()
    total = whole[0] or 0
    rates = {t: min(max((whole[i + 1] or 0.0) / total if total else 0.5, 1e-4), 1 - 1e-4) for i, t in enumerate(TARGETS)}
    parent = sums.select(*levels, "n", *TARGETS, *[F.lit(rates[t]).alias(f"{t}_rate") for t in TARGETS])
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        here = parent.groupBy(*keys).agg(F.sum("n").alias("n_here"), *[F.sum(t).alias(f"{t}_here") for t in TARGETS], *[F.first(f"{t}_rate").alias(f"{t}_up") for t in TARGETS])
        here = stage(here, "quality-level")
        moments = []
        for t in TARGETS:
            noise = F.col(f"{t}_up") * (1 - F.col(f"{t}_up"))
            gap = F.pow(F.col(f"{t}_here") / F.col("n_here") - F.col(f"{t}_up"), 2)
            moments += [F.avg(noise), F.avg(gap - noise / F.col("n_here"))]
        values = here.agg(*moments).first()
        posts = []
        for i, t in enumerate(TARGETS):
            noise, spread = values[2 * i] or 0.25, values[2 * i + 1] or 0.0
            strength = min(max(noise / max(spread, 1e-9) - 1, 2.0), 1e6)
            posts.append(((F.col(f"{t}_here") + strength * F.col(f"{t}_up")) / (F.col("n_here") + strength)).alias(f"{t}_rate"))
        post = here.select(*[F.col(k).alias(f"{k}_at") for k in keys], *posts)
        same = [F.col(k).eqNullSafe(F.col(f"{k}_at")) for k in keys]
        parent = stage(parent.drop(*[f"{t}_rate" for t in TARGETS]).join(post, same).drop(*[f"{k}_at" for k in keys]), "quality-level")
    return parent.select(*levels, *[f"{t}_rate" for t in TARGETS])


class Judge:
    """A fitted classifier: evidence of documents and priors of sites; with ``carry`` the documents stay beside their evidence."""

    def __init__(self, docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", carry: bool = False):
        self.host, self.path = host, path
        spark = docs.sparkSession
        known = stage(clean_labels(labels), "quality-labels")
        self.model = learn_evidence(docs, known)
        shared = spark.sparkContext.broadcast(self.model)

        def score(texts: pd.Series) -> pd.DataFrame:
            rows = [evidence((t or "").encode("utf-8", "surrogatepass"), shared.value) for t in texts]
            return pd.DataFrame(np.array(rows).reshape(-1, len(TARGETS)), columns=[f"{t}_llr" for t in TARGETS])

        self.evidence = F.pandas_udf(score, ", ".join(f"{t}_llr double" for t in TARGETS))
        text = F.col("text").cast("string")
        whole = [F.struct("*").alias("document")] if carry else []
        sites = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *self._levels(), self.evidence(text).alias("e"), *whole)
        kept = ["document"] if carry else []
        self.scored = stage(sites.select("doc_id", "host", "path", *[F.col(f"e.{t}_llr").alias(f"{t}_llr") for t in TARGETS], *kept), "quality-evidence")
        truth = known.select("doc_id", *[F.col(t).alias(f"{t}_label") for t in TARGETS])
        soft = [F.coalesce(F.col(f"{t}_label").cast("double"), logistic(F.col(f"{t}_llr") + logit(self.model["prior"][t]))).alias(t) for t in TARGETS]
        self.priors = site_priors(self.scored.join(truth, "doc_id", "left").select("host", "path", *soft), ["host", "path"])

    def _levels(self) -> list[Column]:
        return [F.col(self.host).alias("host"), F.col(self.path).alias("path")]

    def decide(self, rows: DataFrame) -> DataFrame:
        """Rows with host, path and evidence columns, and the probability of each target."""
        at = self.priors.select(F.col("host").alias("host_at"), F.col("path").alias("path_at"), *[f"{t}_rate" for t in TARGETS])
        met = rows.join(at, F.col("host").eqNullSafe(F.col("host_at")) & F.col("path").eqNullSafe(F.col("path_at")), "left").drop("host_at", "path_at")
        prior = lambda t: F.coalesce(F.col(f"{t}_rate"), F.lit(self.model["prior"][t]))
        return met.withColumns({f"{t}_p": logistic(F.col(f"{t}_llr") + F.log(prior(t) / (1 - prior(t)))) for t in TARGETS})


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


REJECT = " OR ".join(f"{t}_p >= 0.5" for t in TARGETS)


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, low_p, toxic_p, score (probability of neither) and kept for each row of ``docs``.

    Null text is an empty text; a null source or language is a site of its own; labels of unknown
    documents and rows without a label teach nothing.  Without labels every document has evidence 0 and
    is kept.  Repeated rows are judged alike; other columns are ignored.
    """
    judge = Judge(docs, labels)
    decided = judge.decide(judge.scored)
    return decided.select("doc_id", "low_p", "toxic_p", ((1 - F.col("low_p")) * (1 - F.col("toxic_p"))).alias("score"), (~F.expr(REJECT)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are.

    Evidence is worked out once and written beside the documents; what decides then is the rate of the site alone, so
    texts meet a table of sites.  Nulls count as values of their own; an empty table stays empty; very long texts are read whole.
    """
    judge = Judge(docs, labels, carry=True)
    return judge.decide(judge.scored).filter(~F.coalesce(F.expr(REJECT), F.lit(False))).select("document.*")
