import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators.aggregates import HOURS
from panelspark.plans import stages
from panelspark.session import shared_dir
from panelspark.streaming.ingest import append_new_weather

HEADER = "Station ID,Pollutant,Date," + ",".join(HOURS)


def test_reports_to_region_days(spark, tmp_path):
    text = ["Station, One (101)", "Latitude, 43 Longitude, -79", HEADER]
    text += ["101,PM,2024-01-01," + ",".join(["2"] * 10 + ["9999"] * 14)] * 2  # an exact copy
    text += ["101,PM,2024-01-01," + ",".join(["4"] * 10 + ["-999"] * 2 + ["6"] * 12)]  # conflicts in ten hours
    text += ["Station, Two (102)", "Latitude, 44 Longitude, -80", HEADER, "102,PM,2024-01-01," + ",".join(["9"] * 14 + ["9999"] * 10)]
    (tmp_path / "ON_PM25_2024-01-01_2024-12-31.csv").write_text("\n".join(text))
    lookup = spark.createDataFrame(
        [(101, " North ", 1), (102, "North", 2), (101, "Alpha", 3)], "station_id long, region string, row int")
    hourly = stages.hourly_table(spark, str(tmp_path), lookup, lookup_order=["row"])
    assert hourly.columns == ["station_id", "Pollutant", "Date", "station_name", "region", "latitude", "longitude", *HOURS]
    first = hourly.where("station_id = 101").first()
    assert (first["H01"], first["H11"], first["H13"], first["station_name"]) == (3.0, None, 6.0, "One")
    got = stages.region_day_pm(hourly, lookup, min_hours=15, lookup_order=["row"])
    want = (10 * 3 + 12 * 6) / 22
    assert rows(got) == [(day(0), "North", want, 2, 1)]


def weather(spark):
    data = [
        (s, f"2024-01-{d + 1:02d}", str(10 * s + d), "T" if d == 1 else None, None if d == 1 else "2", str(43 + s / 10), "-79")
        for s in (1, 2, 50) for d in range(3)
    ] + [(1, "2024-01-01", "99", None, "0", "43.1", "-79")]
    return spark.createDataFrame(
        [(float(s), *rest, i) for i, (s, *rest) in enumerate(data)],
        "station_id double, `Date/Time` string, `Max Temp (°C)` string, `Total Rain Flag` string, `Total Rain (mm)` string, "
        "`Latitude (y)` string, `Longitude (x)` string, `Source Row` int",
    )


def test_weather_to_region_days(spark):
    sites = spark.createDataFrame([(1, "s", "North", 43.15, -79.0)], "ord int, site_id string, region string, lat double, lon double")
    got = stages.region_day_weather(weather(spark), sites, order=["source_row"]).orderBy("date")
    out = got.select("region", "date", "max_temp_degc", "total_rain_mm", "total_rain_mm_is_trace").collect()
    assert [tuple(r) for r in out] == [
        ("North", day(0), 15.0, 2.0, 0.0), ("North", day(1), 16.0, 0.0, 1.0), ("North", day(2), 17.0, 2.0, 0.0)
    ]
    assert not [c for c in got.columns if "station" in c]


def test_panel_to_features(spark):
    rng = np.random.default_rng(3)
    n = 40
    data = [
        (r, day(i), float(rng.normal(5)), float(rng.normal()) if i % 6 else None, None, 0, 1.0)
        for r in ("North", "South", "Renfrew County") for i in range(n) if i != 20
    ]
    panel = spark.createDataFrame(
        data, f"region string, date date, {stages.PM} double, mean_temp_degc double, total_snow_cm double, "
        "x_is_outlier int, flat double",
    ).withColumn("total_snow_cm", F.when(F.col("mean_temp_degc") > 0, F.col("mean_temp_degc") * 2))
    imputed = stages.imputed_panel(panel)
    assert imputed.columns == ["region", "date", stages.PM, "mean_temp_degc", "total_snow_cm"]
    assert imputed.where("total_snow_cm is null").count() == 0 and imputed.count() == 2 * (n - 1)
    labelled = stages.labelled_panel(imputed, "2024-01-01", "2024-02-09")
    featured = stages.featured_panel(labelled).toPandas()
    pdf = labelled.toPandas().sort_values(["region", "date"])
    by = pdf.groupby("region")
    pdf["lag14"] = by[stages.PM].shift(14)
    pdf["roll"] = by["mean_temp_degc"].transform(lambda s: s.rolling(7, min_periods=7).mean())
    merged = featured.merge(pdf[["region", "date", "lag14", "roll"]], on=["region", "date"])
    assert len(featured) > 0 and not featured.isna().any().any()
    np.testing.assert_allclose(merged[f"{stages.PM}_lag_14"], merged["lag14"])
    np.testing.assert_allclose(merged["mean_temp_degc_roll_mean_7"], merged["roll"])
    features = stages.model_features(spark.createDataFrame(featured))
    assert stages.LABEL not in features and "sin_doy" in features and "region" not in features


def test_joined_panel_normalises_headers(spark):
    pm = spark.createDataFrame([("N", day(0), 1.0)], "Region string, ` Date ` date, pm double")
    wx = spark.createDataFrame([("N", day(0), 2.0)], "region string, DATE date, T double")
    assert rows(stages.joined_panel(pm, wx)) == [("N", day(0), 1.0, 2.0)]


def test_new_files_are_cleaned_incrementally(spark, tmp_path):
    raw = weather(spark).drop("Source Row")
    source, out, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    for month in (1, 2):
        raw.where(F.col("Date/Time").startswith("2024-01-01") if month == 1 else F.col("station_id") == 50).coalesce(1).write.mode(
            "append").csv(source, header=True)
        append_new_weather(spark, source, raw.schema, out, progress).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == raw.where(F.col("Date/Time").startswith("2024-01-01")).count() + 3
    assert "total_rain_mm_is_trace" in got.columns


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert pd.notna(shared_dir(spark))
