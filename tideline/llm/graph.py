"""Connected components by alternating large-star and small-star rounds, all state in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import durable


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo) with lo < hi."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
    return small.where("lo < hi").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    Each round is written to the shared folder, so lineage stays short. The number of rounds grows with the logarithm of
    the longest chain. Null ends and loops make no edge.
    """
    e = durable(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("lo < hi").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if now == before or not now[0]:
            break
        before = now
        e = durable(_round(e), "edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
