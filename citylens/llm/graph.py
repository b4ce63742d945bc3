"""Connected components of an undirected link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers
    until nothing changes, and contracts the links.  Rounds are written to shared storage, so lineage
    stays short.  Self links and repeated links are allowed.
    """
    links = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = stage(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("top")), "pointers")
        while True:
            nxt = up.select(F.col("node").alias("top"), F.col("top").alias("higher"))
            jumped = stage(up.join(nxt, "top").select("node", F.col("higher").alias("top"), (F.col("higher") != F.col("top")).alias("moved")), "pointers")
            up = jumped.select("node", "top")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = up.withColumnRenamed("top", "component")
        else:
            moved = found.join(up.withColumnRenamed("node", "component"), "component", "left")
            found = stage(moved.select("node", F.coalesce("top", "component").alias("component")), "components")
        a, b = (up.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top")) for c in "ab")
        links = stage(links.join(a, "a").join(b, "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b")).filter("a <> b").distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
