"""The paths from raw files to a forecast. Each composes lazily; only a table that several jobs read is written in between."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from panelspark.functions.names import normalise_headers, rename_roles, reorder, station_column
from panelspark.operators.aggregates import HOURS, numeric_mean_by, region_day, station_day
from panelspark.operators.clean import clean_weather, drop_null_rows, null_sentinels, prune_panel
from panelspark.operators.dedupe import first_per_key, merge_key_duplicates
from panelspark.operators.geo import nearest_site, station_coordinates
from panelspark.operators.impute import ffill, fill_zero, interpolate_forward
from panelspark.operators.joins import (
    attach_region_by_site, attach_station_meta, attach_station_region, calendar_spine, fill_region, join_panels,
)
from panelspark.operators.windows import next_label, panel_features
from panelspark.session import materialise
from panelspark.sources.reports import extract_station_meta, read_block_report, report_preambles

KEY = ["station_id", "Pollutant", "Date"]

# Codes for a missing hour.
MISSING_CODES = [-999, 9999]

# Which weather columns are imputed how, and up to how many days.
ZERO_FILLED = ["total_snow_cm", "snow_on_grnd_cm", "total_rain_mm", "total_precip_mm"]
INTERPOLATED = {
    "max_temp_degc": 5, "min_temp_degc": 5, "mean_temp_degc": 5,
    "heat_deg_days_degc": 5, "cool_deg_days_degc": 5, "spd_of_max_gust_km_h": 3,
}
REPEATED = {"dir_of_max_gust_deg": 2, "dir_of_max_gust_10s_deg": 2}

# Which columns get which lags and rolling windows.
PM_LAGS, PM_WINDOWS, PM_DIFFS = [1, 2, 3, 7, 14], [3, 7, 14], [1, 7]
WEATHER_LAGGED = [
    "max_temp_degc", "min_temp_degc", "mean_temp_degc", "heat_deg_days_degc", "cool_deg_days_degc",
    "total_rain_mm", "total_snow_cm", "total_precip_mm", "snow_on_grnd_cm",
    "spd_of_max_gust_km_h", "dir_of_max_gust_deg",
]
WEATHER_LAGS = [1, 7]
WEATHER_ROLLED = [
    "mean_temp_degc", "total_precip_mm", "total_rain_mm", "total_snow_cm", "snow_on_grnd_cm", "spd_of_max_gust_km_h",
]
WEATHER_WINDOWS = [3, 7]

# The region left out for its gaps, and the first and last day of the study.
DROPPED_REGIONS = ["Renfrew County"]
STUDY_START, STUDY_END = "2020-01-01", "2024-12-31"

PM = "pm25_region_daily_avg"
LABEL = "pm25_label"

# Columns of a featured panel that are no predictors.
NOT_PREDICTORS = ["date", "region", "longitude_x", "latitude_x", "longitude_y", "latitude_y", LABEL]


def hourly_table(
    spark: SparkSession, reports: str | list[str], lookup: DataFrame | None = None, keep_year: bool = False, *,
    lookup_order: Sequence[str] = (),
) -> DataFrame:
    """Report files to one row per station, pollutant and day with 24 hours and the station's attributes.

    ``lookup`` has (station_id, region) and the columns of ``lookup_order``, its source order: of several rows of a
    station the first counts. Of several preambles of a station that of the first file and block counts.
    """
    readings = rename_roles(read_block_report(spark, reports), {"Station ID": "station_id"})
    meta = extract_station_meta(report_preambles(spark, reports))
    stations = first_per_key(meta, ["station_id"], ["file", "block", "place"]).drop("file", "block", "place")
    if lookup is not None:
        stations = attach_station_region(stations, lookup, order=lookup_order)
    joined = null_sentinels(attach_station_meta(readings, stations), HOURS, MISSING_CODES)
    # Equal rows need no step of their own: they add no distinct value to their key.
    merged = merge_key_duplicates(materialise(joined, "hourly"), KEY, HOURS)
    out = merged if keep_year else merged.drop("year")
    return reorder(out, [*KEY, "station_name", "region", "latitude", "longitude"], HOURS)


def region_day_pm(hourly: DataFrame, lookup: DataFrame, min_hours: int = 0, *, lookup_order: Sequence[str]) -> DataFrame:
    """Hourly table to the mean per region and day; ``lookup`` as for ``hourly_table``."""
    mapped = fill_region(hourly, lookup, order=lookup_order)
    daily = station_day(mapped, min_hours, name="pm25_daily_avg")
    return region_day(daily, "Date", "region", "station_id", "pm25_daily_avg", PM)


def region_day_weather(
    raw: DataFrame, sites: DataFrame, threshold_km: float = 75.0, *, order: Sequence[str],
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Raw daily weather to the mean of every numeric column, or of the ``measures``, per region and day.

    ``order`` is the source's.
    """
    clean = materialise(clean_weather(raw, order), "clean-weather")
    points = station_coordinates(clean, "latitude_y", "longitude_x", station_column(clean), order)
    nearest = nearest_site(points.withColumnRenamed("weather_station_id", "point_id"), sites, threshold_km)
    return numeric_mean_by(attach_region_by_site(clean, nearest), ["region", "date"], measures)


def joined_panel(pm: DataFrame, weather: DataFrame, how: str = "inner") -> DataFrame:
    return join_panels(normalise_headers(pm), normalise_headers(weather), how=how)


def imputed_panel(panel: DataFrame, dropped: Sequence[str] = DROPPED_REGIONS) -> DataFrame:
    """Pruned panel with bounded gaps filled; the target is never imputed."""
    kept = fill_zero(prune_panel(materialise(panel, "panel"), dropped), ZERO_FILLED)
    return ffill(interpolate_forward(kept, "region", "date", INTERPOLATED), "region", "date", REPEATED)


def labelled_panel(panel: DataFrame, start: str = STUDY_START, end: str = STUDY_END) -> DataFrame:
    """Panel on the full calendar with the next row's value as label."""
    return next_label(calendar_spine(panel, "region", "date", start, end), "region", "date", PM, LABEL)


def featured_panel(panel: DataFrame) -> DataFrame:
    """All features of a labelled panel; rows with any null are left out."""
    lags = {PM: PM_LAGS, **{c: WEATHER_LAGS for c in WEATHER_LAGGED if c in panel.columns}}
    windows = {PM: PM_WINDOWS, **{c: WEATHER_WINDOWS for c in WEATHER_ROLLED if c in panel.columns}}
    featured = panel_features(panel, "region", "date", lags, windows, {PM: PM_DIFFS})
    return drop_null_rows(featured, [c for c in featured.columns if c not in ("region", "date")])


def model_features(panel: DataFrame, numeric: Mapping[str, str] | None = None) -> list[str]:
    """Numeric predictors of a featured panel: no coordinates, label or keys."""
    names = numeric or dict(panel.dtypes)
    plain = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in names.items() if t in plain and c not in NOT_PREDICTORS]
