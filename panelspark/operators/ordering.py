"""Global order without a single-task window: positions, order statistics and rank cut-offs.

The rows are range-partitioned on the order keys and written once; one count per partition then gives
every partition its starting position. The only thing that reaches the driver is one row per partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number within a partition in its low 33 bits


def ordered_index(df: DataFrame, *keys: Column | str, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys`` over the whole table."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialise(ranged.withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_slot", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, position = [], 0
    for row in sizes:
        starts.append((row["_part"], position))
        position += row["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    within = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + within)
        .drop("_slot", "_part", "_start")
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, without gathering the column in one task.

    Copies of a value are combined before the shuffle, the distinct values are range-partitioned, and only
    the partitions that hold a wanted rank are scanned for it.
    """
    weighted = (
        df.select(F.col(value).cast("double").alias("v")).where("v is not null")
        .groupBy("v").agg(F.count("*").alias("n"))
    )
    stored = materialise(
        weighted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "quantiles"
    )
    sizes = stored.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(row["n"] for row in sizes)
    if total == 0:
        return [None] * len(probs)
    spots = [p * (total - 1) for p in probs]
    ranks = sorted({r for s in spots for r in (math.floor(s), math.ceil(s))})
    wanted, start = {}, 0
    for row in sizes:
        inside = [r - start for r in ranks if start <= r < start + row["n"]]
        if inside:
            wanted[row["part"]] = (start, inside)
        start += row["n"]
    running = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hit = F.lit(False)
    for part, (_, inside) in wanted.items():
        near = F.lit(False)
        for r in inside:
            near = near | ((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
        hit = hit | ((F.col("part") == part) & near)
    picked = (
        stored.where(F.col("part").isin(list(wanted)))
        .withColumn("upto", F.sum("n").over(running))
        .where(hit)
        .collect()  # at most one row per wanted rank
    )
    found = {}
    for row in picked:
        start, inside = wanted[row["part"]]
        for r in inside:
            if row["upto"] - row["n"] <= r < row["upto"]:
                found[start + r] = row["v"]
    out = []
    for spot in spots:
        low, high = found[math.floor(spot)], found[math.ceil(spot)]
        out.append(low + (high - low) * (spot - math.floor(spot)))
    return out


def day_counts(df: DataFrame, date: str) -> list[tuple]:
    """(day, rows) in order: as many as the calendar has days."""
    if df.schema[date].dataType != T.DateType():
        raise TypeError(f"{date} must hold days")
    return [tuple(row) for row in df.groupBy(date).count().orderBy(date).collect()]


def before_rank(df: DataFrame, date: str, tie: str, days: list[tuple], rank: int) -> Column:
    """Condition that holds for exactly the first ``rank`` rows in (date, tie) order.

    ``days`` are the ``day_counts``. Only the rows of the day in which the cut falls are ordered, and those by
    a distributed index. (date, tie) must be unique.
    """
    if rank <= 0:
        return F.lit(False)
    seen = 0
    for day, count in days:
        if seen + count > rank:
            cut_day, left = day, rank - seen
            break
        seen += count
    else:
        return F.lit(True)
    if left == 0:
        return F.col(date) < F.lit(cut_day)
    same_day = ordered_index(df.where(F.col(date) == F.lit(cut_day)).select(tie), tie)
    cut_tie = same_day.where(F.col("position") == left).first()[tie]
    return (F.col(date) < F.lit(cut_day)) | ((F.col(date) == F.lit(cut_day)) & (F.col(tie) < F.lit(cut_tie)))
