"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelspark.session import materialise


def _stored(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a checksum taken on the way."""
    seen = Observation()
    stored = materialise(edges.observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("check")), label)
    return stored, (seen.get["n"], seen.get["check"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the smallest node it can reach.

    Alternating large-star and small-star steps: each step is two aggregates and joins over the edges, hubs are
    reduced before the shuffle, and about log(n) steps suffice. Every step is a written table, so a lost
    executor costs one step at most. Null ends and loops are left out; no edges give no rows.
    """
    current, state = _stored(
        edges.where(f"`{a}` <> `{b}`")
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    while state[0]:
        both = current.union(current.select("lo", "hi")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.where("hi <> lo").distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.toDF("hi", "lo"))
        before = state
        current, state = _stored(small.where("hi <> lo").distinct(), "small-star")
        if state == before:
            break
    roots = current.select("lo").distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        roots.select("lo", F.col("lo").alias("root"))
    )
