import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators.aggregates import HOURS
from panelspark.operators.windows import sequences
from panelspark.sources import files, pages, reports, schema, sinks

META = ["station_id", "station_name", "latitude", "longitude"]
HEADER = "Station ID,Pollutant,Date," + ",".join(HOURS)


def line(station, date, *values):
    return ",".join([str(station), "PM", date, *map(str, values), *["9999"] * (24 - len(values))]) + ",,"


REPORT = "\n".join([
    "Report of the year",
    line(100, "2024-01-01", 99),  # before any header: ignored
    "Station, Main Street (101) of the city", "Latitude, 43.5", "Longitude, -79.25", "",
    HEADER,
    line(101, "2024-01-01", 1, 2), "", line(101, "2024-01-02", "n/a", 3),
    "Station, Second, Road (102)", "station, Third Road (103)", "LATITUDE, 44 Longitude, -80",
    line(102, "2024-01-01", 5),  # after the line that ended the block: ignored
    HEADER,
    line(103, "2024-01-01", 7), line(103, "someday", -999), "12,PM,too few digits",
    line(103, "2024-01-03", 8),  # ignored again
    HEADER,
    line(104, "2024-01-01", 9),
    HEADER,
    line(105, "2024-01-01", 10),
])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("reports")
    (root / "ON_PM25_2024-01-01_2024-12-31.csv").write_text(REPORT)
    (root / "ON_PM25_2023-01-01_2023-12-31.csv").write_text("\n".join([HEADER, line(201, "2023-05-01", 4)]))
    return root


EXPECTED = [
    (101, day(0), 1.0, 2.0, 2024), (101, day(1), None, 3.0, 2024), (103, None, -999.0, None, 2024),
    (103, day(0), 7.0, None, 2024), (104, day(0), 9.0, None, 2024), (105, day(0), 10.0, None, 2024),
]


def test_block_report(spark, folder):
    got = reports.read_block_report(spark, f"{folder}/ON_PM25_2024*").select("Station ID", "Date", "H01", "H02", "year")
    assert rows(got, "Station ID", "Date") == EXPECTED
    both = reports.read_block_report(spark, str(folder))
    assert rows(both.where("year = 2023").select("Station ID", "Pollutant", "H01", "H24")) == [(201, "PM", 4.0, None)]


def test_block_report_in_many_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        assert reports.report_lines(spark, str(folder)).select("split").distinct().count() > 5
        got = reports.read_block_report(spark, f"{folder}/ON_PM25_2024*").select("Station ID", "Date", "H01", "H02", "year")
        assert rows(got, "Station ID", "Date") == EXPECTED
        meta = reports.extract_station_meta(reports.report_preambles(spark, f"{folder}/ON_PM25_2024*")).select(*META)
        assert rows(meta, "station_id") == [(101, "Main Street", 43.5, -79.25), (103, "Third Road", 44.0, -80.0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_not_shuffled(spark, folder):
    plan = reports.read_block_report(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_a_file_without_headers(spark, tmp_path):
    path = tmp_path / "ON_PM25_2021-01-01_x.csv"
    path.write_text("Station, Lone (9)\nLatitude, 1\nLongitude, 2\n" + "free text\n" * 500 + line(9, "2021-01-01", 1))
    assert reports.read_block_report(spark, str(path)).count() == 0
    text = reports.report_preambles(spark, str(path)).collect()
    assert len(text) == 1 and text[0]["text"].count("\n") == 2
    assert rows(reports.extract_station_meta(spark.createDataFrame(text)).select(*META)) == [(9, "Lone", 1.0, 2.0)]


def test_column_order_is_the_blocks_own(spark, tmp_path):
    path = tmp_path / "ON_PM25_2022-01-01_x.csv"
    path.write_text("Station ID,Pollutant,Date,H02,H01\n301,PM,2022-01-01,2,1\n302,PM,2022-01-01,5\n")
    got = reports.read_block_report(spark, str(path)).select("Station ID", "H01", "H02", "H03")
    assert rows(got, "Station ID") == [(301, 1.0, 2.0, None), (302, None, 5.0, None)]


def test_year_is_required_in_the_file_name(spark, tmp_path):
    path = tmp_path / "PM25_latest.csv"
    path.write_text("\n".join([HEADER, line(201, "2023-05-01", 4)]))
    with pytest.raises(Exception, match="no year in"):
        reports.read_block_report(spark, str(path)).collect()


def test_station_meta_in_text(spark):
    texts = spark.createDataFrame([("STATION,  A b (7)\nx\ny Latitude,1.5\n Longitude,-2.25 Station,C (8) Latitude,3 Longitude,4",), ("none",)], "text string")
    assert rows(reports.extract_station_meta(texts).select(*META)) == [(7, "A b", 1.5, -2.25), (8, "C", 3.0, 4.0)]


def test_tagged_files_and_coverage(spark, tmp_path):
    for sid, year in ((1, 2020), (1, 2021), (22, 2021)):
        folder = tmp_path / f"station_{sid}"
        folder.mkdir(exist_ok=True)
        (folder / f"station_{sid}_daily_{year}.csv").write_text(f"Date/Time,Max Temp (°C)\n{year}-01-01,{sid}\n")
    got = files.read_tagged(spark, f"{tmp_path}/station_*/*.csv")
    assert rows(got.select("station_id", "year", "Max Temp (°C)"), "station_id", "year") == [
        ("1", 2020, "1"), ("1", 2021, "1"), ("22", 2021, "22")
    ]
    (tmp_path / "station_22" / "station_22_daily_2022.csv").write_text("Rain,Date/Time\n4,2022-01-01\n")
    mixed = files.read_tagged(spark, f"{tmp_path}/station_22/*.csv").select("year", "Date/Time", "Max Temp (°C)", "Rain")
    assert rows(mixed, "year") == [(2021, "2021-01-01", "22", None), (2022, "2022-01-01", None, "4")]
    ids = spark.createDataFrame([("1",), ("22",), ("3",), ("3",)], "station_id string")
    assert rows(files.load_coverage(got, ids, [2020, 2021, 2022]), "year") == [(2020, 1, 2), (2021, 2, 1), (2022, 0, 3)]


def test_id_list_and_first_existing(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 10 \n\n   \n7\n")
    assert sorted(r[0] for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["10", "7"]
    (tmp_path / "final.csv").write_text("Date,H01\n2024-01-01 10:00:00,5\nbad,6\n")
    got = files.first_existing(spark, [str(tmp_path / "panel.csv"), str(tmp_path / "final.csv")])
    assert rows(got, "H01") == [(day(0), "5"), (None, "6")]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, [str(tmp_path / "absent.csv")])


def test_ids_of_pages(spark):
    html = [
        '<a href="/x?y=1&StationID=30">a</a><input type="hidden" name="stationID" value=" 4 ">StationID=100',
        "<a href='?StationID=30'>a</a><input name='other' value='77'><input value='9' name='StationID'/>",
        "<a href='?StationID=abc'>a</a><input name='StationID' value='x1'>", "nothing",
    ]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    assert [r[0] for r in pages.station_ids(df).collect()] == ["4", "9", "30", "100"]
    assert pages.page_links(df).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    sinks.write_table(df, str(tmp_path / "deep" / "er" / "t"), "csv", codec="gzip")
    assert list((tmp_path / "deep" / "er" / "t").glob("*.csv.gz"))
    assert rows(files.read_table(spark, str(tmp_path / "deep" / "er" / "t")), "k") == [("1", "a"), ("2", None)]
    sinks.write_table(df, str(tmp_path / "p"), partition_by=["k"])
    assert (tmp_path / "p" / "k=1").exists()
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_sequence_files(spark, tmp_path):
    df = spark.createDataFrame([("a", day(i), float(i), 1.0) for i in range(4)], "e string, d date, v double, y double")
    made = sequences(df, "e", "d", ["v"], "y", 3)
    sinks.write_sequences(made, str(tmp_path / "s"), ["v"])
    stored, names = sinks.read_sequences(spark, str(tmp_path / "s"))
    assert names == ["v"] and rows(stored, "end_date") == rows(made, "end_date")


def test_schema_report(spark):
    df = spark.range(9).withColumn("x", F.col("id") * 0.5)
    assert rows(schema.schema_report(df, order=["id"])) == [(1, "id", "bigint", "0 | 1 | 2"), (2, "x", "double", "0.0 | 0.5 | 1.0")]
