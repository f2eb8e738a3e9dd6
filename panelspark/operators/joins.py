"""Equi-joins of readings, lookups and panels.

No broadcast is forced here: the lookup side is broadcast by Spark when its size, measured at run time,
is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise the skew-aware sort-merge join is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.dedupe import first_per_key


def attach_station_meta(df: DataFrame, stations: DataFrame, key: str = "station_id") -> DataFrame:
    return df.join(stations, key, "left")


def region_lookup(
    lookup: DataFrame, key: str, region: str, order: Sequence[Column | str]
) -> DataFrame:
    """Lookup with trimmed names, no null ids, and the first row per id in ``order``, that of the source."""
    named = lookup.where(F.col(key).isNotNull()).withColumn(region, F.trim(region))
    return first_per_key(named, [key], order).select(key, region)


def attach_station_region(
    stations: DataFrame, lookup: DataFrame, key: str = "station_id", region: str = "region", *,
    order: Sequence[Column | str],
) -> DataFrame:
    return stations.join(region_lookup(lookup, key, region, order), key, "left")


def fill_region(
    df: DataFrame, lookup: DataFrame, key: str = "station_id", region: str = "region", *,
    order: Sequence[Column | str],
) -> DataFrame:
    """Keep the region a row has; otherwise take it from the lookup."""
    found = region_lookup(lookup, key, region, order).withColumnRenamed(region, "_found")
    joined = df.join(found, key, "left")
    if region in df.columns:
        joined = joined.withColumn(region, F.coalesce(F.col(region), F.col("_found")))
        return joined.select(*df.columns)
    return joined.withColumnRenamed("_found", region)


def unmapped_keys(
    df: DataFrame, lookup: DataFrame, key: str, carry: Sequence[str] = (), require: bool = False
) -> DataFrame:
    """Keys without a lookup row, with their number of rows: the template of what is still to be filled."""
    known = lookup.select(key).where(F.col(key).isNotNull())
    per_key = df.groupBy(key).agg(F.count("*").alias("n_rows"), *[F.min(c).alias(c) for c in carry])
    missing = per_key.join(known, key, "left_anti")
    if require and not missing.isEmpty():
        raise ValueError(f"no mapping for {missing.count()} keys of {key}")
    return missing


def attach_region_by_site(
    weather: DataFrame, nearest: DataFrame, station: str = "station_id", point: str = "point_id"
) -> DataFrame:
    """Left join of readings to the nearest-site lookup on ids of any spelling (3920, '3920.0')."""
    def whole(name: str) -> Column:  # exact to 38 digits, where a double would confuse ids over 2 ** 53
        return F.col(name).cast("string").try_cast("decimal(38,6)").cast("decimal(38,0)").cast("string")

    ids = nearest.select(whole(point).alias("_id"), F.col("assigned_region").alias("region"))
    keyed = weather.withColumn(station, whole(station))
    return keyed.join(ids, keyed[station] == ids["_id"], "left").drop("_id")


def join_panels(left: DataFrame, right: DataFrame, on: Sequence[str] = ("region", "date"), how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def calendar_spine(df: DataFrame, entity: str, date: str, start: str, end: str) -> DataFrame:
    """Every entity on every day of the range; days without a row get nulls, rows outside the range go.

    Null entities are left out and a repeated (entity, day) fails, since it has no place on the grid.
    """
    rest = [c for c in df.columns if c not in (entity, date)]
    inside = df.where(F.col(entity).isNotNull())
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    grid = inside.select(entity).distinct().select(entity, F.explode(days).alias(date))
    once = inside.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(
        entity, date
    ).agg(
        F.any_value(F.struct(F.lit(1).alias("_one"), *rest)).alias("_row"), F.count("*").alias("_copies")
    )
    row = F.when(F.col("_copies") > 1, F.raise_error(F.lit("duplicate entity and day"))).otherwise(F.col("_row"))
    filled = grid.join(once.withColumn("_row", row), [entity, date], "left")
    return filled.select(*[F.col(c) if c in (entity, date) else F.col("_row")[c].alias(c) for c in df.columns])


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name; a column absent from a frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_ids(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
