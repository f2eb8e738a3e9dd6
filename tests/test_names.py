import pytest

from panelspark.functions import names


def test_snake_name():
    assert names.snake_name(" Max Temp (°C) ") == "max_temp_degc"
    assert names.snake_name("Spd of Max Gust (km/h)") == "spd_of_max_gust_km_h"
    assert names.snake_name("Date/Time") == "date_time"
    assert names.snake_name("__a--b__") == "a_b"


def test_duplicate_names_keep_the_last(spark):
    df = spark.range(1).selectExpr("1 as `Year`", "2 as b", "3 as `year`")
    out = names.snake_case(df)
    assert out.columns == ["b", "year"]
    assert out.first()["year"] == 3


def test_roles(spark):
    df = spark.range(1).selectExpr("1 as `Station ID`", "2 as `Latitude`", "3 as H10", "4 as H02", "5 as DATE_UTC", "6 as H100")
    assert names.pick_col(df, ["station_id"]) == "Station ID"
    assert names.pick_col(df, ["lat", "LATITUDE"]) == "Latitude"
    assert names.pick_col(df, ["region"], required=False) is None
    with pytest.raises(ValueError):
        names.pick_col(df, ["region"])
    assert names.station_column(df) == "Station ID"
    assert names.station_column(df.select("Latitude")) is None
    assert names.date_column(df) == "DATE_UTC"
    with pytest.raises(ValueError):
        names.date_column(df.select("H10"))
    assert names.hour_columns(df) == ["H02", "H10"]
    assert names.region_feature(["x", "Zone"]) == "Zone"


def test_selection_and_order(spark):
    df = spark.range(1).selectExpr("id", "1.5D as mean", "'x' as name", "2 as a_flag", "3 as Station_no")
    assert names.numeric_columns(df, exclude=["id"], exclude_containing="station") == ["mean", "a_flag"]
    assert names.drop_matching(df, suffix="_flag", contains=["mea"], names=["name"]).columns == ["id", "Station_no"]
    assert names.reorder(df, ["name", "none"], ["id"]).columns == ["name", "mean", "a_flag", "Station_no", "id"]
    assert names.rename_roles(df, {"mean": "m", "none": "n"}).columns[1] == "m"
    with pytest.raises(ValueError):
        names.require_columns(df, ["mean", "absent"])
    assert names.normalise_headers(df.toDF(" A ", "B", "C", "D", "E")).columns == ["a", "b", "c", "d", "e"]
