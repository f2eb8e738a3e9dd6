"""Event days and runs of consecutive event days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.segments import BLOCK_DAYS, day_number, in_blocks


def event_day(mean: str, hours: str, threshold: float = 25.0, min_hours: int = 18) -> Column:
    """Whether the mean reaches the threshold on enough valid hours; false where either is missing."""
    return F.coalesce((F.col(mean) >= threshold) & (F.col(hours) >= min_hours), F.lit(False))


def event_days(df: DataFrame, mean: str, hours: str, threshold: float = 25.0, min_hours: int = 18) -> DataFrame:
    return df.withColumn("event_day", event_day(mean, hours, threshold, min_hours))


def event_episodes(
    df: DataFrame, entity: str, date: str, value: str, event: str = "event_day", block_days: int = BLOCK_DAYS
) -> DataFrame:
    """Runs of event days without a missing day, longest first, then by highest value.

    An episode starts on an event day whose previous row is not an event or is not the day before. Each block of days
    gives its runs as mergeable summaries; of these only the runs that touch a block's first or last day can be
    continued, and such neighbours are merged. A block's number of starts then numbers the episodes of the next one.
    """
    w = W.partitionBy(entity, "_block").orderBy(date)
    goes_on = F.coalesce(F.lag(event).over(w) & (F.datediff(date, F.lag(date).over(w)) == 1), F.lit(False))
    marked = in_blocks(df, entity, date, block_days).withColumn("_starts", (F.col(event) & ~goes_on).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.where(F.col(event)).groupBy(entity, "_block", "_run").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count("*").alias("n_days"),
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.max(value).alias("max_value"))
    first, last = F.col("_block") * block_days, F.col("_block") * block_days + block_days - 1
    runs = runs.withColumn("_open", (day_number("start_date") == first) | (day_number("end_date") == last))

    order = W.partitionBy(entity).orderBy("start_date")  # two open runs per block at most
    goes_on = F.coalesce(F.datediff("start_date", F.lag("end_date").over(order)) == 1, F.lit(False))
    edges = runs.where("_open").withColumn("_goes_on", goes_on)
    head = F.last(F.when(~F.col("_goes_on"), F.struct("_block", "_run")), ignorenulls=True)
    merged = edges.withColumn("_head", head.over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy(entity, "_head").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("n_days").alias("n_days"),
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("max_value").alias("max_value"))
    columns = [entity, "_block", "_run", "start_date", "end_date", "n_days", "_sum", "_n", "max_value"]
    every = runs.where(~F.col("_open")).select(*columns).unionByName(
        merged.withColumns({"_block": F.col("_head")["_block"], "_run": F.col("_head")["_run"]}).select(*columns))

    held = edges.where("_goes_on").groupBy(entity, "_block").agg(F.count("*").alias("_continued"))  # 1: the block's first run
    counts = runs.groupBy(entity, "_block").agg(F.count("*").alias("_runs")).join(held, [entity, "_block"], "left").fillna(
        0, ["_continued"])
    earlier = W.partitionBy(entity).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_base", F.coalesce(F.sum(F.col("_runs") - F.col("_continued")).over(earlier), F.lit(0)))
    return every.join(starts, [entity, "_block"]).select(
        entity, (F.col("_base") + F.col("_run") - F.col("_continued")).alias("episode_id"), "start_date", "end_date", "n_days",
        F.try_divide("_sum", "_n").alias("mean_value"), "max_value",
    ).orderBy(F.desc("n_days"), F.desc("max_value"), entity, "episode_id")
