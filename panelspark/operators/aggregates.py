"""Aggregations from readings to the entity-by-day and region-by-day panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.names import numeric_columns, require_columns
from panelspark.functions.scalars import apply_min_hours, quoted, row_mean, valid_count

HOURS = [f"H{hour:02d}" for hour in range(1, 25)]


def hourly_wide(df: DataFrame, keys: Sequence[str], hour: Column, value: str) -> DataFrame:
    """Readings to one row per key with a mean per hour, in columns H01 to H24."""
    slots = df.withColumn("_hour", hour)
    means = [F.expr(f"avg(if(_hour = {i}, {quoted(value)}, null)) as {name}") for i, name in enumerate(HOURS, 1)]
    return slots.groupBy(*keys).agg(*means)


def station_day(df: DataFrame, min_hours: int = 0, hours: Sequence[str] = HOURS, name: str = "daily_mean") -> DataFrame:
    """Mean over the hour columns, missing if fewer than ``min_hours`` of them hold a value."""
    require_columns(df, hours)
    counted = df.withColumns({"n_hours": valid_count(hours), name: row_mean(hours)})
    return counted.withColumn(name, apply_min_hours(F.col(name), F.col("n_hours"), min_hours)).drop(*hours)


def station_day_from_readings(
    df: DataFrame, keys: Sequence[str], hour: Column, value: str, min_hours: int = 0, name: str = "daily_mean"
) -> DataFrame:
    """``station_day`` of readings in long form: mean of the hourly means, without the 24 wide columns."""
    hourly = df.groupBy(*keys, hour.alias("_hour")).agg(F.avg(value).alias("_mean"))
    daily = hourly.groupBy(*keys).agg(F.count("_mean").alias("n_hours"), F.avg("_mean").alias(name))
    return daily.withColumn(name, apply_min_hours(F.col(name), F.col("n_hours"), min_hours))


def region_day(
    df: DataFrame, date: str, region: str, station: str, value: str, name: str = "region_daily_mean"
) -> DataFrame:
    """Mean of station-day means per region and day; days without a region form a group of their own."""
    return df.groupBy(date, region).agg(
        F.avg(value).alias(name),
        F.count_distinct(station).alias("n_stations_total"),
        F.count(value).alias("n_stations_used"),
    )


def numeric_mean_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column, station columns apart, for rows that have all keys.

    ``measures`` names the columns to average instead, so that coordinates, indicators and date parts can be left out; a name
    that is not a numeric column is an error.
    """
    cols = numeric_columns(df, exclude=keys, exclude_containing=None if measures is not None else "station")
    if measures is not None:
        unknown = [m for m in measures if m not in cols]
        if unknown:
            raise ValueError(f"no numeric columns {unknown} among {df.columns}")
        cols = list(measures)
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def mean_series(df: DataFrame, date: str, value: str, name: str = "mean") -> DataFrame:
    return df.where(F.col(date).isNotNull()).groupBy(date).agg(F.avg(value).alias(name))


def entity_weighted(df: DataFrame, entity: str, period: Column, value: str, period_name: str, name: str) -> DataFrame:
    """Mean per entity and period, then the mean of those: each entity counts once per period."""
    per_entity = (
        df.where(F.col(entity).isNotNull()).withColumn(period_name, period)
        .where(F.col(period_name).isNotNull())
        .groupBy(entity, period_name).agg(F.avg(value).alias("_mean"))
    )
    return per_entity.groupBy(period_name).agg(F.avg("_mean").alias(name))


def entity_weighted_monthly(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    return entity_weighted(df, entity, F.trunc(date, "MM"), value, "month", "entity_weighted_mean")


def seasonality(df: DataFrame, entity: str, date: str, value: str) -> DataFrame:
    return entity_weighted(df, entity, F.month(date), value, "month_num", "entity_weighted_mean")


def hour_profile(df: DataFrame, hours: Sequence[str] = HOURS, name: str = "mean") -> DataFrame:
    """Mean per hour of the day from wide hour columns."""
    means = df.agg(*[F.expr(f"avg({quoted(c)}) as `{int(c[1:])}`") for c in hours])
    return means.unpivot([], [str(int(c[1:])) for c in hours], "hour", name).withColumn(
        "hour", F.col("hour").cast("int")
    )


def mean_by_entity(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and number of values per entity, highest mean first; rows with a null key are left out."""
    return (
        df.dropna(subset=list(keys)).groupBy(*keys)
        .agg(F.avg(value).alias("mean"), F.count(value).alias("n_days"))
        .orderBy(F.desc("mean"), *keys)
    )


def top_entities(ranked: DataFrame, by: str = "mean", n: int = 30, tie: str | None = None) -> DataFrame:
    order = [F.desc(by)] + ([F.col(tie)] if tie else [])
    return ranked.orderBy(*order).limit(max(5, n))


def tail_by_date(series: DataFrame, date: str, n: int = 30) -> DataFrame:
    return series.orderBy(F.desc(date)).limit(n).orderBy(date)


def sort_panel(df: DataFrame, entity: str, date: str) -> DataFrame:
    return df.orderBy(entity, date)


def rank_by(df: DataFrame, col: str, absolute: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(F.abs(col)) if absolute else F.desc(col), *tie)
