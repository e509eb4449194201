"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelloom.llm.common import checkpointed


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)`` of all nodes of ``edges(a, b)``: the smallest node reachable.

    Alternates large-star and small-star steps, so the number of rounds grows with the
    logarithm of the longest path. Minima are pre-aggregated before each shuffle, and a
    node with very many neighbours is an ordinary skewed join key, which Spark splits.
    Nulls and loops are ignored; no edges give no rows. Only counts reach the driver.
    """
    pairs = edges.select("a", "b").where("a <> b")
    pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = fingerprint(pairs)
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("x"), "low", "a")
        small = small.select(F.col("x").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b")))
        pairs = checkpointed(small.where("a <> b").distinct())
        before, state = state, fingerprint(pairs)
        if state == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.distinct())


def fingerprint(pairs: DataFrame) -> tuple:
    """Count and content of a set of pairs, independent of their order."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
