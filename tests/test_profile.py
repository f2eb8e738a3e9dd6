import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators import profile


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 300), "x": rng.gamma(2, 3, 300), "y": rng.normal(size=300)})
    pdf.loc[rng.random(300) < 0.1, "y"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, sample):
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in sample.itertuples(index=False)],
                                 "g long, x double, y double")


def test_missingness(spark):
    data = [("a", None, 1), (None, None, 2), ("a", 3.0, None), ("b", 1.0, 4)]
    df = spark.createDataFrame(data, "k string, x double, y int")
    pdf = pd.DataFrame(data, columns=["k", "x", "y"])
    want = pdf.isna().mean()
    assert {r["column"]: r["missing_rate"] for r in profile.missing_rates(df).collect()} == dict(want)
    assert profile.overall_missing_rate(df).first()[0] == pytest.approx(want.mean())
    assert rows(profile.row_missing_histogram(df)) == [(0, 1), (1, 2), (2, 1)]
    by = {r["k"]: r["missing_rate"] for r in profile.missing_rate_by(df, "k").collect()}
    assert by == pytest.approx({"a": 1 / 3, "b": 0.0})
    table = profile.missing_rates_by_entity(df, "k", ["x", "absent"], ["y", "none"], order=["y"])
    assert rows(table) == [("a", 1, 2, 0.5), (None, 2, 1, 1.0), ("b", 4, 1, 0.0)]
    with pytest.raises(ValueError):
        profile.missing_rates_by_entity(df, "k", ["absent"])
    assert rows(profile.all_missing_by_date(df, "k", ["x", "y"])) == [("a", 0), ("b", 0)]


def test_moments_match_pandas(df, sample):
    got = profile.describe_adjusted(df, "x").first()
    assert got["variance"] == pytest.approx(sample.x.var())
    assert got["skewness"] == pytest.approx(sample.x.skew())
    assert got["kurtosis"] == pytest.approx(sample.x.kurt())


def test_summaries_match_pandas(df, sample):
    for got in (profile.distribution_summary(df, "y").first(), profile.series_summary(df, "y").first()):
        assert got["n"] == sample.y.count()
        assert got["std"] == pytest.approx(sample.y.std())
        for name, p in profile.QUANTILES.items():
            assert got[name] == pytest.approx(sample.y.quantile(p))


def test_variance_split(df, sample):
    got = profile.variance_split(df, "g", "x").first()
    means = sample.groupby("g").x.mean()
    assert tuple(got) == pytest.approx((sample.x.var(), means.var(), sample.groupby("g").x.var().mean()))


def test_correlation(df, sample):
    wide = df.withColumns({"zeros": F.lit(0.0), "same": F.lit(4.0)})
    got = {r["column"]: r["correlation"] for r in profile.corr_with_target(wide, "y").collect()}
    want = sample.dropna().corr()["y"]
    assert got["x"] == pytest.approx(want["x"]) and got["g"] == pytest.approx(want["g"])
    assert got["same"] is None and "zeros" not in got


@pytest.mark.parametrize("bins", [1, 7, 50])
def test_histogram(df, sample, bins):
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "x", bins).collect()}
    want, _ = np.histogram(sample.x, bins=bins)
    assert [got.get(i, 0) for i in range(bins)] == want.tolist()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert rows(profile.histogram(df, "v", 5)) == [(0, 2.0, 2)]


def test_completeness(spark):
    df = spark.createDataFrame([("a", day(i)) for i in range(6)] + [("b", day(0))], "e string, d date")
    got = profile.completeness(df, "e", "2020-01-01", "2024-12-31").first()
    assert got["n_days"] == 1827 and got["completeness_pct"] == pytest.approx(7 / (2 * 1827) * 100)


def test_autocorrelation(spark):
    rng = np.random.default_rng(4)
    values = pd.Series(np.cumsum(rng.normal(size=120)))
    values[30] = None
    df = spark.createDataFrame([("s", day(i), None if pd.isna(v) else float(v)) for i, v in enumerate(values)],
                               "k string, d date, v double")
    got = {r["lag"]: r["correlation"] for r in profile.lag_autocorr(df, "k", "d", "v").collect()}
    assert got == pytest.approx({k: values.autocorr(k) for k in range(1, 15)})
    x = values.dropna().to_numpy() - values.mean()
    want = {k: (x[k:] * x[: len(x) - k]).sum() / (x * x).sum() for k in range(21)}
    got = {r["lag"]: r["acf"] for r in profile.acf(df, "k", "d", "v").collect()}
    assert got == pytest.approx(want)


def test_acf_of_a_short_or_flat_series(spark):
    df = spark.createDataFrame([("flat", day(i), 1.0) for i in range(3)], "k string, d date, v double")
    assert rows(profile.acf(df, "k", "d", "v"), "lag") == [("flat", 0, None), ("flat", 1, None), ("flat", 2, None)]


def test_audit(spark):
    first, seen = profile.observe_step(spark.createDataFrame([(1, None), (2, 3)], "a int, b int"), "start")
    first.collect()
    assert rows(profile.audit_table(first, [("start", 2, seen)])) == [("start", 2, 2, 1)]
