"""Series cut into blocks of days, so that one long series is the work of many tasks.

A block of an entity is summarised in a row; the summaries are scanned in order, and what a block needs from the others
is joined back to its rows. Only the scan sees an entity as a whole, one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_DAYS = 256
DUPLICATE = "duplicate entity and day"


def day_number(date: str) -> Column:
    return F.unix_date(F.col(date).cast("date"))


def in_blocks(df: DataFrame, entity: str, date: str, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Rows with an entity and a day, with their ``_block`` and their place ``_at`` in it, from 1.

    (entity, day) must be unique, which is checked within the blocks: equal days are in one block.
    """
    present = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).withColumn(date, F.col(date).cast("date"))
    w = W.partitionBy(entity, "_block").orderBy(date)
    placed = present.withColumn("_block", F.floor(day_number(date) / block_days)).withColumns(
        {"_before": F.lag(date).over(w), "_at": F.row_number().over(w)})
    repeated = F.when(F.col("_before") == F.col(date), F.raise_error(F.lit(DUPLICATE)))
    return placed.where(repeated.cast("int").isNull()).drop("_before")


def surrounding(
    df: DataFrame, entity: str, date: str, cols: Sequence[str], ahead: bool, block_days: int = BLOCK_DAYS
) -> DataFrame:
    """Add the row number in the series and, per column, the last reading up to here (and the next one).

    A reading is a struct of its row number ``at`` and its value ``v``. What a block lacks comes from the blocks around it,
    each summarised by its number of rows and its first and last reading of every column.
    """
    placed = in_blocks(df, entity, date, block_days)
    back = W.partitionBy(entity, "_block").orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    fore = W.partitionBy(entity, "_block").orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0)

    def reading(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_at").cast("long").alias("at"), F.col(c).alias("v")))

    inner = {f"_in_last{i}": F.last(reading(c), ignorenulls=True).over(back) for i, c in enumerate(cols)}
    if ahead:
        inner |= {f"_in_next{i}": F.last(reading(c), ignorenulls=True).over(fore) for i, c in enumerate(cols)}
    rows = placed.withColumns(inner)

    summary = placed.groupBy(entity, "_block").agg(
        F.count("*").alias("_rows"),
        *[F.max_by(reading(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_end{i}") for i, c in enumerate(cols)],
        *[F.min_by(reading(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_start{i}") for i, c in enumerate(cols) if ahead])
    earlier = W.partitionBy(entity).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(entity).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    scanned = summary.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("long")))

    def moved(struct: str) -> Column:
        """The reading, numbered within the series."""
        found = F.col(struct)
        return F.when(found.isNotNull(), F.struct((F.col("_base") + found["at"]).alias("at"), found["v"].alias("v")))

    carried = {f"_prior{i}": F.last(moved(f"_end{i}"), ignorenulls=True).over(earlier) for i in range(len(cols))}
    if ahead:
        carried |= {f"_after{i}": F.last(moved(f"_start{i}"), ignorenulls=True).over(later) for i in range(len(cols))}
    scanned = scanned.withColumns(carried).select(entity, "_block", "_base", *carried)

    joined = rows.join(scanned, [entity, "_block"])
    found = {"_rn": F.col("_base") + F.col("_at")}
    for i, c in enumerate(cols):
        found[f"_last_{c}"] = F.coalesce(moved(f"_in_last{i}"), F.col(f"_prior{i}"))
        if ahead:
            found[f"_next_{c}"] = F.coalesce(moved(f"_in_next{i}"), F.col(f"_after{i}"))
    return joined.withColumns(found).select(*df.columns, *found)
