"""URL filters: allow and block rules by host suffix and path prefix.

Each url is expanded into host-suffix and path-prefix expressions of the shapes the rules have, the
expressions meet the rules in an equi-join on eight hex digits of their SHA-256, full digests are
compared afterwards, and the longest rule decides.  Everything is column expressions.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separates host and path inside a digest; neither part of a parsed url can hold it.
JOINT = "?"
PREFIX_DIGITS = 8


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for null and for text without ``://``.

    Columns of those names are replaced.
    """
    part = lambda group: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    host = F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase)
    return urls.withColumns({"host": host, "path": part(2)})


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their shape and digest; rules with a null part are no rules.

    A shape is the number of host labels, the number of slashes in the path and the number of
    characters after the last slash: exactly what is needed to cut the same piece out of a url.
    """
    pieces = F.split("path", "/")
    return rules.dropna(subset=["host", "path", "verdict"]).select(
        F.struct(
            F.size(F.split("host", r"\.")).alias("labels"), (F.size(pieces) - 1).alias("depth"), F.length(F.element_at(pieces, -1)).alias("tail"),
        ).alias("shape"),
        F.sha2(F.concat("host", F.lit(JOINT), "path"), 256).alias("rule_digest"),
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.col("verdict").alias("rule_verdict"),
    ).distinct()


def judge_urls(urls: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: key, url, host, path, rule (null if none fits) and verdict.

    Rules fit a host and all its subdomains where the url's path starts with the rule's.  The longest
    rule string wins, then the longer host, then ``block``.  Urls without a rule get ``default``.
    Repeated (key, url) rows are judged once and come back as often as they went in; nulls are kept.
    The only data sent to the driver are the distinct rule shapes, bounded by what host names and
    paths can look like and not by the number of urls or rules.
    """
    keys = rule_keys(rules)
    shapes = [r[0] for r in keys.select("shape").distinct().collect()]
    listed = ", ".join(f"named_struct('labels', {s.labels}, 'depth', {s.depth}, 'tail', {s.tail})" for s in shapes)
    expressions = f"""
        transform(
            filter(array({listed}), s -> s.labels <= size(labels) AND s.depth < size(pieces) AND s.tail <= length(element_at(pieces, s.depth + 1))),
            s -> concat(
                array_join(slice(labels, size(labels) - s.labels + 1, s.labels), '.'), '{JOINT}',
                array_join(slice(pieces, 1, s.depth), '/'), IF(s.depth > 0, '/', ''), substring(element_at(pieces, s.depth + 1), 1, s.tail)))
    """ if shapes else "CAST(array() AS ARRAY<STRING>)"
    counted = urls.groupBy(F.col(key).alias("key"), F.col(url).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    expanded = (
        split_url(counted).withColumns({"labels": F.split("host", r"\."), "pieces": F.split("path", "/")})
        .select("key", "url", "host", "path", "copies", F.explode_outer(F.transform(F.expr(expressions), lambda e: F.sha2(e, 256))).alias("digest"))
    )
    short = lambda c: F.substring(c, 1, PREFIX_DIGITS)
    fits = F.col("digest") == F.col("rule_digest")
    met = expanded.withColumn("prefix", short("digest")).join(keys.drop("shape").withColumn("prefix", short("rule_digest")), "prefix", "left")
    best = F.max(F.when(fits, F.struct(F.length("rule"), "host_length", "rule_verdict", "rule"))).alias("best")
    judged = met.groupBy("key", "url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), best)
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        F.col("key").alias(key), F.col("url").alias(url), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
