"""Cleaning of raw columns: coercion, sentinels, quality flags, range checks, and column pruning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.names import drop_matching, numeric_columns, snake_case
from panelspark.functions.scalars import (
    date_parts, direction_degrees, has_mark, normalise_id, quoted, to_day, to_number,
)
from panelspark.operators.dedupe import first_per_key

# The measured columns of a daily weather file.
WEATHER_NUMBERS = [
    "longitude_x", "latitude_y",
    "max_temp_degc", "min_temp_degc", "mean_temp_degc",
    "heat_deg_days_degc", "cool_deg_days_degc",
    "total_rain_mm", "total_snow_cm", "total_precip_mm", "snow_on_grnd_cm",
    "dir_of_max_gust_10s_deg", "spd_of_max_gust_km_h",
    "station_id",
]

# Each measured column with the column that holds its quality letter.
WEATHER_FLAGS = {
    "max_temp_degc": "max_temp_flag",
    "min_temp_degc": "min_temp_flag",
    "mean_temp_degc": "mean_temp_flag",
    "heat_deg_days_degc": "heat_deg_days_flag",
    "cool_deg_days_degc": "cool_deg_days_flag",
    "total_rain_mm": "total_rain_flag",
    "total_snow_cm": "total_snow_flag",
    "total_precip_mm": "total_precip_flag",
    "snow_on_grnd_cm": "snow_on_grnd_flag",
    "dir_of_max_gust_10s_deg": "dir_of_max_gust_flag",
    "spd_of_max_gust_km_h": "spd_of_max_gust_flag",
}

# The closed interval of plausible values per column.
WEATHER_RANGES = {
    "max_temp_degc": (-60, 50),
    "min_temp_degc": (-60, 50),
    "mean_temp_degc": (-60, 50),
    "total_rain_mm": (0, 500),
    "total_precip_mm": (0, 500),
    "total_snow_cm": (0, 200),
    "snow_on_grnd_cm": (0, 300),
    "spd_of_max_gust_km_h": (0, 250),
    "dir_of_max_gust_deg": (0, 359.999),
}

# Quality letters and what each stands for; precipitation columns in which "T" means a trace.
FLAG_MEANINGS = {"trace": "T", "estimated": "E", "missingflag": "M", "lowquality": "L"}
TRACE_COLUMNS = ["total_rain", "total_snow", "total_precip", "snow_on_grnd"]


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    present = df.columns
    return df.withColumns({c: to_number(c) for c in cols if c in present})


def coerce_date(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or col, to_day(col))


def null_sentinels(df: DataFrame, cols: Sequence[str], values: Sequence[float]) -> DataFrame:
    """Sentinel values and NaN become null."""
    present, codes = df.columns, ", ".join(f"{v}D" for v in values)
    return df.withColumns({
        c: F.expr(f"if({quoted(c)} in ({codes}) or isnan({quoted(c)}), null, {quoted(c)})") for c in cols if c in present
    })


def flag_indicators(df: DataFrame, value_col: str, flag_col: str) -> DataFrame:
    """One 0/1 column per quality letter; no flag counts as no letter."""
    return all_flag_indicators(df, {value_col: flag_col})


def all_flag_indicators(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """``flag_indicators`` of every pair of a value and a flag column that is present."""
    present = df.columns
    return df.withColumns({
        f"{value_col}_is_{meaning}": F.expr(f"tinyint(coalesce({quoted(flag_col)}, '') = '{letter}')")
        for value_col, flag_col in flags.items() if value_col in present and flag_col in present
        for meaning, letter in FLAG_MEANINGS.items()
    })


def zero_trace(df: DataFrame, value_cols: Sequence[str]) -> DataFrame:
    """A trace of precipitation counts as 0."""
    present = df.columns
    traced = [c for c in value_cols if f"{c}_is_trace" in present]
    return df.withColumns({c: F.expr(f"if({quoted(c + '_is_trace')} = 1, 0D, {quoted(c)})") for c in traced})


def range_check(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside the closed interval become null and are marked in ``<column>_is_outlier``."""
    checks, present = {}, df.columns
    for c, (low, high) in bounds.items():
        if c not in present:
            continue
        outside = F.coalesce(~F.col(c).between(low, high), F.lit(False))
        checks[f"{c}_is_outlier"] = outside.cast("byte")
        checks[c] = F.when(~outside, F.col(c))
    return df.withColumns(checks)


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def exclude(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is not listed; a null value is kept."""
    return df.where(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def _dull_columns(df: DataFrame, zero: bool, eps: float | None) -> list[str]:
    """Numeric columns that are 0 throughout, or whose sample variance is below ``eps``: one pass for both."""
    cols = numeric_columns(df)
    if not cols:
        return []
    found = [
        F.struct(
            F.bool_and(F.coalesce(F.col(c) == 0, F.lit(False))).alias("zero"),
            F.try_divide(F.var_pop(c) * F.count(c), F.count(c) - 1).alias("variance"),
        ).alias(c)
        for c in cols
    ]
    row = df.agg(*found).first()
    flat = [c for c in cols if eps is not None and row[c]["variance"] is not None and row[c]["variance"] < eps]
    return flat + [c for c in cols if zero and row[c]["zero"]]


def drop_all_zero(df: DataFrame) -> DataFrame:
    """Drop numeric columns that are 0 in every row; one null keeps the column."""
    return df.drop(*_dull_columns(df, zero=True, eps=None))


def drop_near_constant(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Drop numeric columns whose sample variance is below ``eps``."""
    return df.drop(*_dull_columns(df, zero=False, eps=eps))


def clean_rows(raw: DataFrame, keep_flags: bool = False) -> DataFrame:
    """The row-wise part of weather cleaning; it holds no state and runs on a stream as well."""
    df = snake_case(raw)
    text = {}
    if "station_name" in df.columns:
        text["station_name"] = F.trim("station_name")
    if "climate_id" in df.columns:
        text["climate_id"] = normalise_id("climate_id")
    df = df.withColumns(text) if text else df
    if "date_time" in df.columns:
        df = df.withColumn("date_time", F.col("date_time").try_cast("timestamp_ntz"))
        df = coerce_date(df, "date_time", "date")
        df = df.withColumns({name: c for name, c in date_parts("date").items() if name != "day_of_year"})
    df = coerce_numeric(df, WEATHER_NUMBERS)
    if "dir_of_max_gust_10s_deg" in df.columns:
        df = df.withColumn("dir_of_max_gust_deg", direction_degrees("dir_of_max_gust_10s_deg"))
    df = all_flag_indicators(df, WEATHER_FLAGS)
    df = zero_trace(df, [c for c in WEATHER_FLAGS if any(part in c for part in TRACE_COLUMNS)])
    if "data_quality" in df.columns:
        df = df.withColumn("data_quality_has_mark", has_mark("data_quality"))
    df = range_check(df, WEATHER_RANGES)
    return df if keep_flags else drop_matching(df, suffix="_flag")


def clean_weather(raw: DataFrame, order: Sequence[str] = (), keep_flags: bool = False) -> DataFrame:
    """Cleaned station-day weather: ``clean_rows``, then the first row per station and day."""
    return first_per_key(clean_rows(raw, keep_flags), ["station_id", "date"], order)


def prune_panel(df: DataFrame, drop_regions: Sequence[str], region: str = "region", eps: float = 1e-8) -> DataFrame:
    """Drop incomplete regions, counts, flag columns, all-zero and near-constant columns."""
    kept = exclude(df, region, drop_regions) if drop_regions else df
    kept = drop_matching(kept, contains=["_is_", "data_quality"], names=["n_stations_total", "n_stations_used"])
    return kept.drop(*_dull_columns(kept, zero=True, eps=eps))
