import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators import aggregates as agg

HOUR_SCHEMA = "station_id long, date date, " + ", ".join(f"{h} double" for h in agg.HOURS)


def hourly(spark, counts):
    data = [(s, day(0), *[float(s)] * n, *[None] * (24 - n)) for s, n in counts]
    return spark.createDataFrame(data, HOUR_SCHEMA)


def test_completeness_rule(spark):
    got = agg.station_day(hourly(spark, [(1, 14), (2, 15), (3, 18), (4, 24), (5, 0)]), min_hours=15)
    assert rows(got, "station_id") == [
        (1, day(0), 14, None), (2, day(0), 15, 2.0), (3, day(0), 18, 3.0), (4, day(0), 24, 4.0), (5, day(0), 0, None),
    ]
    with pytest.raises(ValueError):
        agg.station_day(hourly(spark, [(1, 1)]).drop("H07"))


def test_long_and_wide_agree(spark):
    data = [(1, day(0), 0, 2.0), (1, day(0), 0, 4.0), (1, day(0), 5, 9.0), (2, day(0), 23, 1.0)]
    df = spark.createDataFrame(data, "station_id long, date date, hour int, value double")
    wide = agg.hourly_wide(df, ["station_id", "date"], F.col("hour") + 1, "value")
    assert wide.where("station_id = 1").first()["H01"] == 3.0
    long = agg.station_day_from_readings(df, ["station_id", "date"], F.col("hour"), "value", 2)
    assert rows(long.select("station_id", "n_hours", "daily_mean"), "station_id") == [(1, 2, 6.0), (2, 1, None)]
    assert rows(agg.station_day(wide, 2).select("station_id", "n_hours", "daily_mean"), "station_id") == [(1, 2, 6.0), (2, 1, None)]
    profile = {r["hour"]: r["mean"] for r in agg.hour_profile(wide).collect()}
    assert profile[1] == 3.0 and profile[6] == 9.0 and profile[24] == 1.0 and profile[2] is None


def test_region_day_keeps_the_null_region(spark):
    df = spark.createDataFrame(
        [(day(0), "a", 1, 4.0), (day(0), "a", 2, None), (day(0), None, 3, 5.0), (day(1), "a", 1, None)],
        "date date, region string, station_id long, m double",
    )
    got = rows(agg.region_day(df, "date", "region", "station_id", "m"), "date", "region")
    assert got == [(day(0), None, 5.0, 1, 1), (day(0), "a", 4.0, 2, 1), (day(1), "a", None, 1, 0)]


def test_numeric_means(spark):
    df = spark.createDataFrame(
        [("a", day(0), 1.0, 1, 10, "x"), ("a", day(0), None, 0, 20, "y"), (None, day(0), 9.0, 1, 30, "z")],
        "region string, date date, t double, t_is_trace int, station_id long, note string",
    )
    assert rows(agg.numeric_mean_by(df, ["region", "date"])) == [("a", day(0), 1.0, 0.5)]
    chosen = agg.numeric_mean_by(df, ["region", "date"], ["station_id", "t"])
    assert chosen.columns == ["region", "date", "station_id", "t"] and rows(chosen) == [("a", day(0), 15.0, 1.0)]
    with pytest.raises(ValueError, match="note"):
        agg.numeric_mean_by(df, ["region", "date"], ["t", "note"])


def test_entities_count_once_per_month(spark):
    data = [(1, day(0), 1.0), (1, day(1), 3.0), (2, day(2), 8.0), (None, day(2), 99.0), (1, day(40), 7.0)]
    df = spark.createDataFrame(data, "s long, date date, v double")
    assert rows(agg.entity_weighted_monthly(df, "s", "date", "v"), "month")[0] == (day(0), 5.0)
    assert rows(agg.seasonality(df, "s", "date", "v"), "month_num") == [(1, 5.0), (2, 7.0)]


def test_rankings(spark):
    df = spark.createDataFrame([(i, float(i % 4) if i else None) for i in range(9)] + [(None, 50.0)], "s long, v double")
    ranked = agg.mean_by_entity(df, ["s"], "v")
    assert rows(ranked)[0] == (3, 3.0, 1) and ranked.count() == 9
    assert agg.top_entities(ranked, n=2).count() == 5  # never fewer than five
    daily = spark.createDataFrame([(day(i), float(i)) for i in range(40)], "date date, v double")
    assert [r[0] for r in agg.tail_by_date(daily, "date", 30).collect()] == [day(i) for i in range(10, 40)]
    signs = spark.createDataFrame([(-3.0,), (2.0,)], "c double")
    assert [r[0] for r in agg.rank_by(signs, "c", absolute=True).collect()] == [-3.0, 2.0]
    assert [r[0] for r in agg.sort_panel(daily.withColumn("s", F.lit(1)), "s", "date").take(2)] == [day(0), day(1)]


def test_numeric_mean_needs_all_keys(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", None, 9.0), (None, day(0), 5.0)], "region string, date date, v double")
    assert rows(agg.numeric_mean_by(df, ["region", "date"])) == [("a", day(0), 1.0)]
