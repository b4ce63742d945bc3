"""Corpus preparation: quality, exact copies, near copies, benchmark leaks, then the mix.

Every stage works on all rows that the stage before kept; ``run`` writes each result to the shared folder
and reads it back, so a lost executor costs at most one stage.  Stages that hand texts to Python bound the bytes
of a batch for the session, because what they return is worked out later; ``run`` takes that back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citylens.llm.common import table
from citylens.llm.contamination import drop_leaks
from citylens.llm.exact import drop_copies
from citylens.llm.mixing import mixed_documents
from citylens.llm.quality import keep_good
from citylens.llm.simhash import drop_near_copies
from citylens.session import BATCH_BYTES, bound_batches, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    bound_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    bound_batches(spark)
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints of three-word shingles differ in two bits or fewer."""
    bound_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    bound_batches(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The final mix, one row per repetition of a document."""
    return mixed_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

# Trained and latent stages have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_BYTES, None)
    try:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)
    return docs
