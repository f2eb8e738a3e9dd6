import datetime

import pytest

from panel_helpers import day, rows
from panelspark.operators import joins


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame(
        [(1, " North ", 2), (1, "Wrong", 3), (2, "South", 1), (None, "Nowhere", 0)], "station_id long, region string, pos int"
    )


def test_region_join_takes_first_and_trims(spark, lookup):
    stations = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "station_id long, name string")
    got = joins.attach_station_region(stations, lookup, order=["pos"]).select("station_id", "region")
    assert rows(got, "station_id") == [(1, "North"), (2, "South"), (3, None)]


def test_fill_region_keeps_what_is_there(spark, lookup):
    df = spark.createDataFrame([(1, "Own"), (1, None), (9, None)], "station_id long, region string")
    got = joins.fill_region(df, lookup, order=["pos"])
    assert sorted(rows(got), key=str) == [(1, "North"), (1, "Own"), (9, None)]
    bare = joins.fill_region(df.select("station_id"), lookup, order=["pos"])
    assert bare.columns == ["station_id", "region"]


def test_unmapped_keys(spark, lookup):
    df = spark.createDataFrame([(3, "c"), (3, "c"), (1, "a"), (4, "d")], "station_id long, name string")
    assert rows(joins.unmapped_keys(df, lookup, "station_id", carry=["name"]), "station_id") == [(3, 2, "c"), (4, 1, "d")]
    with pytest.raises(ValueError):
        joins.unmapped_keys(df, lookup, "station_id", require=True)


def test_attach_region_by_site(spark):
    weather = spark.createDataFrame([("3920", 1.0), ("4.0", 2.0), ("5", 3.0)], "station_id string, t double")
    nearest = spark.createDataFrame([("3920.0", "North"), ("4", None)], "point_id string, assigned_region string")
    assert rows(joins.attach_region_by_site(weather, nearest), "t") == [("3920", 1.0, "North"), ("4", 2.0, None), ("5", 3.0, None)]
    close = spark.createDataFrame([("9007199254740993", 1.0)], "station_id string, t double")
    near = spark.createDataFrame([("9007199254740992", "Wrong"), ("9007199254740993.0", "Right")], "point_id string, assigned_region string")
    assert rows(joins.attach_region_by_site(close, near)) == [("9007199254740993", 1.0, "Right")]


def test_join_panels(spark):
    left = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 2.0), ("b", day(0), 3.0)], "region string, date date, x double")
    right = spark.createDataFrame([("a", day(0), 5.0), ("c", day(0), 6.0)], "region string, date date, y double")
    assert rows(joins.join_panels(left, right)) == [("a", day(0), 1.0, 5.0)]
    assert joins.join_panels(left, right, how="left").count() == 3


def test_calendar_spine(spark):
    df = spark.createDataFrame(
        [("a", day(1), 1.0, "x"), ("a", day(9), 2.0, "y"), (None, day(1), 3.0, "z"), ("b", day(0), None, None)],
        "region string, date date, v double, s string",
    )
    got = rows(joins.calendar_spine(df, "region", "date", "2024-01-01", "2024-01-03"), "region", "date")
    assert got == [
        ("a", day(0), None, None), ("a", day(1), 1.0, "x"), ("a", day(2), None, None),
        ("b", day(0), None, None), ("b", day(1), None, None), ("b", day(2), None, None),
    ]
    full = joins.calendar_spine(df, "region", "date", "2020-01-01", "2024-12-31")
    assert full.count() == 2 * (datetime.date(2024, 12, 31) - datetime.date(2020, 1, 1)).days + 2


def test_calendar_spine_refuses_repeated_days(spark):
    df = spark.createDataFrame([("a", day(1), 1.0), ("a", day(1), 2.0)], "region string, date date, v double")
    with pytest.raises(Exception, match="duplicate entity and day"):
        joins.calendar_spine(df, "region", "date", "2024-01-01", "2024-01-03").collect()


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 1)], "v double, k int")
    assert sorted(rows(joins.union_all(a, b).select("k", "s", "v")), key=str) == [(1, "x", None), (1, None, 2.5)]
    assert joins.union_ids(a.select("k"), b.select("k")).count() == 1
    assert joins.distinct_keys(joins.union_all(a, b), ["k"]).count() == 1
