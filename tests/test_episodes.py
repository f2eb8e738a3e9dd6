from panel_helpers import day, rows
from panelspark.operators import episodes


def test_event_bounds(spark):
    df = spark.createDataFrame([(25.0, 18), (24.999, 24), (30.0, 17), (None, 24), (30.0, None)], "m double, h int")
    assert [r["event_day"] for r in episodes.event_days(df, "m", "h").collect()] == [True, False, False, False, False]


def test_episodes(spark):
    data = [
        (1, day(0), 30.0, True), (1, day(1), 40.0, True),  # first row an event
        (1, day(2), 1.0, False), (1, day(3), 26.0, True),  # split by a day without event
        (1, day(5), 27.0, True),  # split by a missing day
        (2, day(5), 28.0, True),
    ]
    df = spark.createDataFrame(data, "s long, d date, v double, event_day boolean")
    assert rows(episodes.event_episodes(df, "s", "d", "v")) == [
        (1, 1, day(0), day(1), 2, 35.0, 40.0), (2, 1, day(5), day(5), 1, 28.0, 28.0),
        (1, 3, day(5), day(5), 1, 27.0, 27.0), (1, 2, day(3), day(3), 1, 26.0, 26.0),
    ]


def test_no_events(spark):
    df = spark.createDataFrame([(1, day(0), 1.0, False)], "s long, d date, v double, event_day boolean")
    assert rows(episodes.event_episodes(df, "s", "d", "v")) == []
