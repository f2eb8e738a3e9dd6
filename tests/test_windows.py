import numpy as np
import pandas as pd
import pytest

from panel_helpers import day, rows
from panelspark.operators import impute, windows


def random_panel(seed, entities=3, n=60, holes=0.35):
    rng = np.random.default_rng(seed)
    frames = []
    for e in range(entities):
        days = sorted(rng.choice(n * 2, n, replace=False))
        values = rng.normal(size=n).round(3)
        values[rng.random(n) < holes] = np.nan
        frames.append(pd.DataFrame({"e": f"r{e}", "d": [day(int(i)) for i in days], "v": values}))
    return pd.concat(frames, ignore_index=True)


def as_spark(spark, pdf, schema="e string, d date, v double"):
    data = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.sample(frac=1, random_state=1).itertuples(index=False)]
    return spark.createDataFrame(data, schema)


def column(df, name):
    return df.orderBy("e", "d").toPandas()[name].astype(float).to_numpy()


def test_lags_rolling_and_diffs(spark):
    pdf = random_panel(1, holes=0.1)
    df = as_spark(spark, pdf)
    got = windows.panel_features(df, "e", "d", {"v": [1, 2, 7]}, {"v": [3, 7]}, {"v": [1, 7]})
    g = pdf.groupby("e")["v"]
    for k in (1, 2, 7):
        np.testing.assert_allclose(column(got, f"v_lag_{k}"), g.shift(k))
    for n in (3, 7):
        roll = g.rolling(n, min_periods=n)
        np.testing.assert_allclose(column(got, f"v_roll_mean_{n}"), roll.mean().to_numpy(), atol=1e-9)
        np.testing.assert_allclose(column(got, f"v_roll_std_{n}"), roll.std().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(column(got, "v_diff_7"), pdf["v"] - g.shift(7))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # every feature shares one shuffle


def test_repeated_day_is_an_error(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(0), 2.0)], "e string, d date, v double")
    with pytest.raises(Exception, match="duplicate entity and day"):
        windows.add_lags(df, "e", "d", {"v": [1]}).collect()


def test_next_label(spark):
    df = spark.createDataFrame(
        [("a", day(0), 1.0), ("a", day(1), None), ("a", day(5), 3.0), ("b", day(0), 9.0)], "e string, d date, v double"
    )
    assert rows(windows.next_label(df, "e", "d", "v"), "e", "d") == [("a", day(1), None, 3.0)]


def test_leap_day(spark):
    import datetime

    df = spark.createDataFrame([(datetime.date(2024, 12, 31),)], "d date")
    got = windows.add_calendar(df, "d").first()
    assert got["day_of_year"] == 366
    assert got["sin_doy"] == pytest.approx(np.sin(2 * np.pi * 366 / 365))


@pytest.mark.parametrize("seed,limit", [(1, 5), (2, 3), (3, 1)])
def test_interpolation_matches_pandas(spark, seed, limit):
    pdf = random_panel(seed, holes=0.6)
    got = column(impute.interpolate_forward(as_spark(spark, pdf), "e", "d", {"v": limit}), "v")
    want = pdf.groupby("e")["v"].transform(lambda s: s.interpolate(method="linear", limit=limit, limit_direction="forward"))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_forward_fill_matches_pandas(spark):
    pdf = random_panel(7, holes=0.6)
    got = column(impute.ffill(as_spark(spark, pdf), "e", "d", {"v": 2, "absent": 1}), "v")
    np.testing.assert_allclose(got, pdf.groupby("e")["v"].ffill(limit=2))


def test_zero_fill(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert rows(impute.fill_zero(df, ["a", "c"])) == [(0.0, None)]


def test_sequences(spark):
    data = [("long", day(i), float(i), float(-i)) for i in range(5)] + [("short", day(i), 0.0, 0.0) for i in range(2)]
    data += [("hole", day(0), 1.0, 1.0), ("hole", day(1), None, 1.0), ("hole", day(2), 2.0, 2.0), ("hole", day(3), 3.0, 3.0)]
    df = spark.createDataFrame(data, "e string, d date, v double, y double")
    got = rows(windows.sequences(df, "e", "d", ["v"], "y", 3), "e", "end_date")
    assert [(r[0], r[1], [s[0] for s in r[2]], r[3]) for r in got] == [
        ("hole", day(3), [1.0, 2.0, 3.0], 3.0), ("long", day(2), [0.0, 1.0, 2.0], -2.0),
        ("long", day(3), [1.0, 2.0, 3.0], -3.0), ("long", day(4), [2.0, 3.0, 4.0], -4.0),
    ]
    tail = windows.sequence_tail(windows.sequences(df, "e", "d", ["v"], "y", 3), 2)
    assert [s[0] for s in tail.where("e = 'hole'").first()["x"]] == [2.0, 3.0]
    with pytest.raises(Exception, match="shorter than"):
        windows.sequence_tail(windows.sequences(df, "e", "d", ["v"], "y", 3), 4).collect()


@pytest.mark.parametrize("length,count", [(13, 0), (14, 1), (15, 2)])
def test_sequence_counts(spark, length, count):
    df = spark.createDataFrame([("a", day(i), 1.0, 1.0) for i in range(length)], "e string, d date, v double, y double")
    assert windows.sequences(df, "e", "d", ["v"], "y").count() == count


def test_split_by_entity(spark):
    df = spark.createDataFrame([("a", day(i)) for i in range(11)] + [("b", day(0))], "e string, d date")
    got = {(r["e"], r["d"]): r["split"] for r in windows.time_split_by(df, "e", "d").collect()}
    assert [got["a", day(i)] for i in range(11)] == ["train"] * 8 + ["test"] * 3
    assert got["b", day(0)] == "test"


def test_split_of_the_whole_table(spark):
    pdf = random_panel(5, entities=7, n=40)
    df = as_spark(spark, pdf).select("e", "d").repartition(3)
    got = windows.time_split(df, "d", "e", 0.8, valid_frac=0.1).toPandas().sort_values(["d", "e"])
    n_train = int(len(pdf) * 0.8)
    n_valid = int(0.1 * n_train)
    assert got["split"].tolist() == ["fit"] * (n_train - n_valid) + ["valid"] * n_valid + ["test"] * (len(pdf) - n_train)
    plain = windows.time_split(df, "d", "e", 0.8).toPandas()
    assert plain[plain.split == "train"]["d"].max() <= plain[plain.split == "test"]["d"].min()
    assert (plain["split"] == "train").sum() == n_train


def test_split_leaves_out_rows_without_a_day(spark):
    df = spark.createDataFrame([(i, day(i) if i > 3 else None) for i in range(10)], "e long, d date")
    got = {r["e"]: r["split"] for r in windows.time_split(df, "d", "e", 0.5).collect()}
    assert got == {4: "train", 5: "train", 6: "train", 7: "test", 8: "test", 9: "test"}
