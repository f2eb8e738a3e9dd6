"""Exact quantiles per group, however many rows a group holds.

A mergeable sketch narrows every wanted rank to a short range of values; the next pass counts what lies below and
inside each range, and only the values inside are put in order. That order is cut by value, so a group that holds most rows is
spread over the cluster as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.session import materialise

ACCURACY = 10_000  # a sketch misses a rank by at most one in so many rows
_INFINITY = float("inf")


def _brackets(values: DataFrame, probs: Sequence[float], accuracy: int) -> DataFrame:
    """(g, spots) per group: each spot's number i, rank, its neighbouring positions and a range that likely holds them.

    Groups that the sketch would not shorten have the whole range.
    """
    near = [max(0.0, p - 2 / accuracy) for p in probs] + [min(1.0, p + 2 / accuracy) for p in probs]
    sketch = values.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", near, accuracy).alias("q"))
    small = F.col("n") <= accuracy

    def spot(i: int, p: float) -> Column:
        rank = F.lit(p) * (F.col("n") - 1)
        return F.struct(
            F.lit(i).alias("i"), rank.alias("rank"), F.floor(rank).alias("first"), F.ceil(rank).alias("last"),
            F.when(small, -_INFINITY).otherwise(F.col("q")[i]).alias("low"),
            F.when(small, float("nan")).otherwise(F.col("q")[len(probs) + i]).alias("high"))  # NaN is above all

    return sketch.select("g", F.array(*[spot(i, p) for i, p in enumerate(probs)]).alias("spots"))


def _checked(values: DataFrame, brackets: DataFrame, n: int) -> DataFrame:
    """The brackets with how many values are below them; one that misses its positions becomes the whole range."""
    counts = []
    for i in range(n):
        spot = F.col("spots")[i]
        counts += [F.count_if(F.col("v") < spot["low"]).alias(f"below{i}"), F.count_if(F.col("v") <= spot["high"]).alias(f"upto{i}")]
    counted = values.join(brackets, "g").groupBy("g").agg(F.any_value("spots").alias("spots"), *counts)

    def settled(i: int) -> Column:
        spot, below = F.col("spots")[i], F.col(f"below{i}")
        holds = (below <= spot["first"]) & (F.col(f"upto{i}") > spot["last"])
        return F.struct(
            spot["i"].alias("i"), spot["rank"].alias("rank"), spot["first"].alias("first"), spot["last"].alias("last"),
            F.when(holds, spot["low"]).otherwise(-_INFINITY).alias("low"),
            F.when(holds, spot["high"]).otherwise(float("nan")).alias("high"), F.when(holds, below).otherwise(0).alias("below"))

    return counted.select("g", F.array(*[settled(i) for i in range(n)]).alias("spots"))


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, accuracy: int = ACCURACY
) -> DataFrame:
    """(keys, one column per name in ``probs``): exact quantiles with linear interpolation.

    Null values are left out, and so are groups without others; a null key is a group; NaN is the largest value.
    ``accuracy`` decides how much is put in order, never the result. ``df`` is read three times: hand in a stored table.
    """
    values = df.select(F.struct(*keys).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    brackets = materialise(_brackets(values, list(probs.values()), accuracy), "brackets")
    spots = materialise(_checked(values, brackets, len(probs)), "spots")

    inside = F.filter("spots", lambda s: (F.col("v") >= s["low"]) & (F.col("v") <= s["high"]))
    held = (
        values.join(spots, "g").select("g", "v", F.explode(inside).alias("s")).groupBy("g", "s.i", "v")
        .agg(F.count("*").alias("n"))
    )
    held = materialise(held.repartitionByRange("g", "i", "v").withColumn("part", F.spark_partition_id()), "inside")
    sizes = held.groupBy("g", "i", "part").agg(F.sum("n").alias("size"))  # a row per range of values that a spot touches
    earlier = W.partitionBy("g", "i").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("g", "i", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    running = W.partitionBy("g", "i", "part").orderBy("v")
    placed = held.withColumn("upto", F.sum("n").over(running)).join(starts, ["g", "i", "part"]).join(
        spots.select("g", F.inline("spots")), ["g", "i"]).withColumn("upto", F.col("upto") + F.col("start") + F.col("below"))

    def at(place: str) -> Column:
        return F.max(F.when((F.col("upto") > F.col(place)) & (F.col("upto") - F.col("n") <= F.col(place)), F.col("v")))

    ends = placed.groupBy("g", "i").agg(at("first").alias("a"), at("last").alias("b"), F.any_value(
        F.col("rank") - F.col("first")).alias("share"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    return ends.groupBy("g").agg(
        *[F.max(F.when(F.col("i") == i, between)).alias(name) for i, name in enumerate(probs)]
    ).select("g.*", *probs)
