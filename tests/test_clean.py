import datetime

from pyspark.sql import functions as F

from panelspark.functions import scalars
from panelspark.operators import clean


def one(spark, *exprs):
    return spark.range(1).select(*exprs).first()


def test_numbers_and_days(spark):
    df = spark.createDataFrame([("12",), (" 3.5 ",), ("<31",), ("NaN",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(scalars.to_number("x")).collect()] == [12.0, 3.5, None, None, None, None]
    days = spark.createDataFrame([("2024-02-29",), ("2024-02-29 13:00:00",), ("2023-02-29",), ("soon",)], "x string")
    leap = datetime.date(2024, 2, 29)
    assert [r[0] for r in days.select(scalars.to_day("x")).collect()] == [leap, leap, None, None]


def test_scalars(spark):
    assert one(spark, scalars.direction_degrees(F.lit(36.0)), scalars.direction_degrees(F.lit(-1.0))) == (0.0, 350.0)
    assert one(spark, scalars.normalise_id(F.lit(" 3920.0 ")), scalars.normalise_id(F.lit("10.05"))) == ("3920", "10.05")
    assert one(spark, scalars.composite_label(F.lit(None).cast("string"), F.lit(7)))[0] == "Unknown (7)"
    assert one(spark, scalars.synthetic_id(F.lit(43.1234567), F.lit(-79.5)))[0] == "lat43.12346_lon-79.5"
    km = one(spark, scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))[0]
    assert abs(km - 6371.0 * 3.141592653589793) < 1e-6
    assert one(spark, scalars.log1p_target(F.lit(-3.0)), scalars.inverse_target(F.lit(-0.5))) == (0.0, 0.0)


def test_row_mean_and_completeness(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (5.0, None, None)], "a double, b double, c double")
    out = df.select(
        scalars.row_mean(["a", "b", "c"]).alias("m"), scalars.valid_count(["a", "b", "c"]).alias("n")
    ).withColumn("k", scalars.apply_min_hours(F.col("m"), F.col("n"), 2))
    assert [tuple(r) for r in out.collect()] == [(2.0, 2, 2.0), (None, 0, None), (5.0, 1, None)]


def test_flags_trace_and_ranges(spark):
    df = spark.createDataFrame(
        [(None, "T", -60.0), (4.0, "E", 50.0), (5.0, "M", 50.1), (6.0, "L", -61.0), (7.0, None, None)],
        "total_rain_mm double, total_rain_flag string, max_temp_degc double",
    )
    out = clean.flag_indicators(df, "total_rain_mm", "total_rain_flag")
    out = clean.range_check(clean.zero_trace(out, ["total_rain_mm"]), {"max_temp_degc": (-60, 50), "absent": (0, 1)})
    got = out.select(
        "total_rain_mm", "total_rain_mm_is_trace", "total_rain_mm_is_estimated", "total_rain_mm_is_missingflag",
        "total_rain_mm_is_lowquality", "max_temp_degc", "max_temp_degc_is_outlier",
    ).collect()
    assert [tuple(r) for r in got] == [
        (0.0, 1, 0, 0, 0, -60.0, 0), (4.0, 0, 1, 0, 0, 50.0, 0), (5.0, 0, 0, 1, 0, None, 1),
        (6.0, 0, 0, 0, 1, None, 1), (7.0, 0, 0, 0, 0, None, 0),
    ]
    assert dict(out.dtypes)["max_temp_degc_is_outlier"] == "tinyint"


def test_sentinels_and_filters(spark):
    df = spark.createDataFrame([(9999.0, "a"), (float("nan"), None), (3.0, "b")], "x double, r string")
    assert [r[0] for r in clean.null_sentinels(df, ["x"], [-999, 9999]).collect()] == [None, None, 3.0]
    assert [r["r"] for r in clean.exclude(df, "r", ["a"]).collect()] == [None, "b"]
    assert clean.drop_null_rows(df, ["r"]).count() == 2


def test_pruned_columns(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 5.0, 1.0), (2, 0.0, None, 5.0, 2.0)], "k int, zero double, hole double, same double, v double"
    )
    assert clean.drop_all_zero(df).columns == ["k", "hole", "same", "v"]
    assert clean.drop_near_constant(df).columns == ["k", "hole", "v"]


def test_clean_weather(spark):
    raw = spark.createDataFrame(
        [
            ("7.0 ", "2024-03-01", "10", "36", "T", None, "50", "x", "first"),
            ("7.0", "2024-03-01", "11", "1", None, "3", None, None, "second"),
            ("7.0", "2024-03-02", "51", "<31", None, "4", "5", None, "third"),
        ],
        "`Climate ID` string, `Date/Time` string, `Max Temp (°C)` string, `Dir of Max Gust (10s deg)` string, "
        "`Total Rain Flag` string, `Total Rain (mm)` string, station_id string, `Data Quality` string, note string",
    ).withColumn("station_id", F.lit("50"))
    out = clean.clean_weather(raw, order=["note"]).orderBy("date").collect()
    assert len(out) == 2
    assert out[0]["note"] == "first" and out[0]["total_rain_mm"] == 0.0 and out[0]["climate_id"] == "7"
    assert out[0]["dir_of_max_gust_deg"] == 0.0 and out[0]["data_quality_has_mark"] == 1
    assert (out[0]["year"], out[0]["month"], out[0]["day"], out[0]["station_id"]) == (2024, 3, 1, 50.0)
    assert out[1]["max_temp_degc"] is None and out[1]["max_temp_degc_is_outlier"] == 1
    assert out[1]["dir_of_max_gust_deg"] is None
    assert "total_rain_flag" not in out[0].asDict()
