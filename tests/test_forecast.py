import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators import forecast, lasso, stationarity
from panelspark.operators.factors import as_factor, factor_rows
from panelspark.operators.moments import moment_rows


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(5.0, 7.0)], "x double, c double")
    assert rows(forecast.apply_scaler(test, forecast.fit_scaler(train, ["x", "c"]), ["x", "c"])) == [(3.0, 2.0)]


def test_metrics(spark):
    y, p = np.array([0.0, -2.0, 4.0, 9.0]), np.array([1.0, -1.0, 5.0, 7.0])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(y, p)] + [("flat", 2.0, 3.0), ("flat", 2.0, 1.0)],
                               "g string, y double, p double")
    got = {r["g"]: r for r in forecast.metrics(df, "y", "p", by="g").collect()}
    a = got["a"]
    assert a["mae"] == pytest.approx(np.abs(y - p).mean()) and a["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert a["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert a["mape_pct"] == pytest.approx(np.mean(np.abs((y - p) / np.maximum(np.abs(y), 1e-6))) * 100)
    assert a["smape_pct"] == pytest.approx(np.mean(2 * np.abs(y - p) / np.maximum(np.abs(y) + np.abs(p), 1e-6)) * 100)
    assert a["pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert got["flat"]["r2"] == 0.0 and got["flat"]["pearson_r"] == 0.0
    signed = forecast.metrics(df.where("g = 'a'"), "y", "p", signed_mape=True).first()
    assert signed["mape_pct"] == pytest.approx(np.mean(np.abs((y - p) / np.maximum(y, 1e-6))) * 100)
    perfect = forecast.metrics(df.withColumn("p", F.col("y")).where("g = 'a'"), "y", "p").first()
    assert perfect["r2"] == 1.0 and perfect["mae"] == 0.0


def test_losses(spark):
    df = spark.createDataFrame([(0.0, 0.5), (10.0, 7.0)], "y double, p double")
    assert forecast.l1_loss(df, "y", "p").first()[0] == 1.75
    assert forecast.huber_loss(df, "y", "p", 1.0).first()[0] == pytest.approx((0.125 + 2.5) / 2)
    train = spark.createDataFrame([(float(i),) for i in range(11)], "y double")  # 90th percentile 9
    want = (0.5 * 1.0 + 3.0 * (1 + 2 * 10 / 9)) / 2
    assert forecast.weighted_l1(df, train, "y", "p", 2.0).first()[0] == pytest.approx(want)
    assert spark.range(1).select(forecast.high_value_weight(F.lit(100.0), 1.0), forecast.high_value_weight(F.lit(-9.0), 1.0)).first() == (5.0, 1.0)


def test_baselines(spark):
    df = spark.createDataFrame([([[1.0, 9.0], [2.0, 9.0], [6.0, 9.0]],)], "x array<array<float>>")
    got = forecast.baselines(df, "x", 0).first()
    assert (got["persistence"], got["window_mean"]) == (6.0, 3.0)


def test_category_index(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), ("d",), (None,)], "c string")
    df = spark.createDataFrame([("a",), ("b",), ("d",), ("c",), (None,)], "c string")
    got = {r["c"]: r["index"] for r in forecast.category_index(train, df, "c").collect()}
    assert got == {"a": 0, "b": 1, "d": 2, "c": 3, None: 3}


def test_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    groups = np.where(rng.random(500) < 0.4, 0, rng.integers(1, 200, 500))
    df = spark.createDataFrame([(int(g), *map(float, r)) for g, r in zip(groups, x)], "g long, a double, b double, c double")
    got = {}
    for r in moment_rows(df.repartition(7), ["g"], ["a", "b", "c"]).collect():
        got.setdefault(r["g"], {})[r["i"]] = r["s"]
    for g in np.unique(groups):
        z = np.c_[np.ones((groups == g).sum()), x[groups == g]]
        np.testing.assert_allclose([got[g][i] for i in range(4)], z.T @ z, atol=1e-9)


def test_factors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 3))
    groups = np.where(rng.random(700) < 0.4, 0, rng.integers(1, 200, 700))
    df = spark.createDataFrame([(int(g), *map(float, r)) for g, r in zip(groups, x)] + [(None, 1.0, 1.0, 1.0)],
                               "g long, a double, b double, c double")
    got = {r["g"]: r for r in factor_rows(df.repartition(7), ["g"], ["a", "b", "c"]).collect()}
    assert sorted(got) == sorted(set(groups.tolist()))
    for g in np.unique(groups):
        z = np.c_[np.ones((groups == g).sum()), x[groups == g]]
        factor = as_factor(got[g]["r"], 4)
        assert got[g]["n"] == len(z) and len(factor) == min(4, len(z))
        np.testing.assert_allclose(factor.T @ factor, z.T @ z, atol=1e-9)


def test_fits_far_from_zero_and_nearly_dependent(spark):
    """Sums of products lose these: their digits end at 1e18 * 1e-16."""
    rng = np.random.default_rng(7)
    n = 200
    u, v = rng.normal(size=(2, n))
    near = u + 1e-5 * v
    y = 2 * u + v
    z = np.c_[np.ones(n), u, near, y] + [0, 1e7, 1e7, 1e7]
    df = spark.createDataFrame([("g", *map(float, r[1:])) for r in z], "g string, a double, b double, y double")
    factor = as_factor(factor_rows(df.repartition(5), ["g"], ["a", "b", "y"]).first()["r"], 4)
    coef = np.linalg.solve(factor[1:3, 1:3], factor[1:3, 3])
    np.testing.assert_allclose(coef, [2 - 1e5, 1e5], rtol=1e-2)
    squares = z.T @ z
    centred = squares[1:, 1:] - np.outer(squares[0, 1:], squares[0, 1:]) / n
    lost = np.linalg.lstsq(centred[:2, :2], centred[:2, 2])[0]
    assert np.abs(lost / [2 - 1e5, 1e5] - 1).max() > 0.1
    data = [("r", day(i), 1e9 + float(u[i]), float(v[i]), 3.0 * float(u[i])) for i in range(n)]
    models, _ = lasso.fit_lasso_by(spark.createDataFrame(data, "e string, d date, a double, b double, y double"), "e", "d", ["a", "b"], "y")
    model, train = models.first(), u[:160]
    assert model["spread"][0] == pytest.approx(train.std(), rel=1e-5)
    assert model["coef"][0] == pytest.approx(3 * train.std(), rel=1e-2) and abs(model["coef"][1]) < 1e-2


def direct_lasso(x, y, penalty, passes=3000):
    coef = np.zeros(x.shape[1])
    for _ in range(passes):
        for j in range(len(coef)):
            rest = y - x @ coef + x[:, j] * coef[j]
            pull = x[:, j] @ rest / len(y)
            coef[j] = np.sign(pull) * max(abs(pull) - penalty, 0) / (x[:, j] @ x[:, j] / len(y))
    return coef


def test_lasso_against_a_direct_fit(spark):
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 1] + [0, 3, 0, -1]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) + 4
    data = [("r", day(i), *map(float, x[i]), float(y[i])) for i in range(n)] + [("few", day(i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(49)]
    df = spark.createDataFrame(data, "e string, d date, a double, b double, c double, k double, y double").repartition(5)
    names = ["a", "b", "c", "k"]
    models, split = lasso.fit_lasso_by(df, "e", "d", names, "y")
    fitted = models.collect()
    assert [r["e"] for r in fitted] == ["r"]  # too few rows are skipped
    model = fitted[0]
    n_train = int(n * 0.8)
    train, target = x[:n_train], y[:n_train]
    z = (train - train.mean(0)) / train.std(0)
    assert model["n_train"] == n_train
    np.testing.assert_allclose(model["mean"], train.mean(0))
    np.testing.assert_allclose(model["spread"], train.std(0))
    top = np.abs(z.T @ (target - target.mean())).max() / n_train
    path = top * np.logspace(0, -3, 100)
    errors = np.zeros(100)
    for held in np.array_split(np.arange(n_train), 5):
        fit = np.setdiff1d(np.arange(n_train), held)
        mx, my = z[fit].mean(0), target[fit].mean()
        for i, penalty in enumerate(path):
            coef = direct_lasso(z[fit] - mx, target[fit] - my, penalty, 60)
            errors[i] += ((target[held] - my - (z[held] - mx) @ coef) ** 2).mean() / 5
    position = int(np.abs(path - model["penalty"]).argmin())
    assert path[position] == pytest.approx(model["penalty"])
    assert errors[position] <= errors.min() * (1 + 1e-4)
    want = direct_lasso(z, target - target.mean(), model["penalty"])
    np.testing.assert_allclose(model["coef"], want, atol=2e-2)
    assert model["intercept"] == pytest.approx(target.mean(), abs=1e-6)
    scored = lasso.score_linear(split, models, "e", names).where("split = 'test'").orderBy("d").collect()
    hat = target.mean() + ((x[n_train:] - train.mean(0)) / train.std(0)) @ np.array(model["coef"])
    np.testing.assert_allclose([r["y_hat"] for r in scored], hat)
    table = lasso.model_metrics(split, models, "e", names, "y").first()
    assert table["n_test"] == n - n_train and table["n_selected_features"] == np.count_nonzero(model["coef"])
    assert table["mae"] == pytest.approx(np.abs(hat - y[n_train:]).mean())
    assert lasso.coefficient_table(models, "e", names).count() == 4
    assert lasso.coefficient_table(models, "e", names, selected=True).where("coef = 0").count() == 0


def test_solve_finds_the_one_true_feature():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(53, 2))
    z = np.c_[np.ones(53), x, x @ [1.0, 0.0]]
    penalty, intercept, coef, _, _, converged = lasso.solve(np.array_split(z, 5), [11, 11, 11, 10, 10])
    assert coef[0] == pytest.approx(x[:, 0].std(), rel=1e-2)  # on the standardised scale
    assert abs(coef[1]) < 0.01 and converged


def test_passes_that_run_out_are_told(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6)) + 3 * rng.normal(size=(60, 1))
    z = np.c_[np.ones(60), x, x.sum(axis=1) + rng.normal(size=60)]
    monkeypatch.setattr(lasso, "MAX_PASSES", 1)
    assert not lasso.solve(np.array_split(z, 5), [12] * 5)[-1]


def test_permutation_importance(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=(n, 2))
    data = [("a" if i % 2 else "b", day(i), float(x[i, 0]), float(x[i, 1]), float(3 * x[i, 0])) for i in range(n)]
    rows_ = spark.createDataFrame(data, "e string, d date, u double, v double, y double").withColumn("y_hat", F.col("u") * 3)
    model = spark.createDataFrame([(e, 0.0, [3.0, 0.0], [0.0, 0.0], [1.0, 1.0]) for e in "ab"],
                                  "e string, intercept double, coef array<double>, mean array<double>, spread array<double>")
    got = {r["feature"]: r["mae_increase"] for r in
           forecast.permutation_importance(rows_, model, "e", "d", ["u", "v"], "y").collect()}
    assert got["v"] == 0.0 and got["e"] == pytest.approx(0.0, abs=1e-9)
    assert 2.5 < got["u"] < 4.5  # mean |3(u - u')| of independent normals is 3.39
    again = forecast.permutation_importance(rows_.repartition(3), model, "e", "d", ["u", "v"], "y").collect()
    assert {r["feature"]: r["mae_increase"] for r in again} == pytest.approx(got)


def direct_adf(x, max_lag):
    dx = np.diff(x)

    def fit(lags, start):
        rows_ = range(start, len(dx))
        z = np.array([[1.0, x[t], *[dx[t - k] for k in range(1, lags + 1)]] for t in rows_])
        y = dx[start:]
        coef, *_ = np.linalg.lstsq(z, y, rcond=None)
        rss = ((y - z @ coef) ** 2).sum()
        t_value = coef[1] / np.sqrt(rss / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
        aic = len(y) * (np.log(2 * np.pi) + np.log(rss / len(y)) + 1) + 2 * z.shape[1]
        return aic, t_value, len(y)

    best = min(range(max_lag + 1), key=lambda k: fit(k, max_lag)[0])
    return best, *fit(best, best)[1:]


def test_adf(spark):
    rng = np.random.default_rng(8)
    noise = rng.normal(size=200)
    steady = np.zeros(200)
    for i in range(2, 200):
        steady[i] = 0.4 * steady[i - 1] + 0.2 * steady[i - 2] + noise[i]
    series = {"walk": np.cumsum(noise) + 1000, "steady": steady, "short": steady[:40]}
    data = [(k, day(i), float(v)) for k, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(data, "k string, d date, v double").repartition(4)
    got = {r["k"]: r for r in stationarity.adf_test(df, "k", "d", "v").collect()}
    for k, s in series.items():
        best, t, n = direct_adf(s, stationarity.longest_lag(len(s)))
        assert got[k]["used_lag"] == best and got[k]["n_obs"] == n
        assert got[k]["adf_statistic"] == pytest.approx(t, rel=1e-6)
    assert got["walk"]["p_value"] > 0.1 and got["steady"]["p_value"] < 0.01


def test_adf_of_series_that_cannot_be_tested(spark):
    rng = np.random.default_rng(8)
    good = np.cumsum(rng.normal(size=60))
    series = {"good": good, "flat": np.ones(50), "three": [1.0, 2.0, 4.0], "one": [1.0], "line": np.arange(40.0)}
    data = [(k, day(i), float(v)) for k, s in series.items() for i, v in enumerate(s)] + [("null", day(0), None)]
    got = {r["k"]: r for r in stationarity.adf_test(spark.createDataFrame(data, "k string, d date, v double"), "k", "d", "v").collect()}
    best, t, n = direct_adf(good, stationarity.longest_lag(len(good)))
    assert (got["good"]["used_lag"], got["good"]["n_obs"]) == (best, n) and got["good"]["adf_statistic"] == pytest.approx(t)
    for k, n_obs in (("flat", 49), ("three", 2), ("one", 0), ("line", 39), ("null", 0)):
        assert (got[k]["adf_statistic"], got[k]["p_value"], got[k]["used_lag"], got[k]["n_obs"]) == (None, None, None, n_obs), k


def test_sequence_scaler(spark):
    x = np.random.default_rng(4).normal(size=(7, 3, 2))
    x[:, :, 1] = 4.0
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(x)], "k long, x array<array<double>>")
    fitted = forecast.fit_sequence_scaler(df.where("k < 5"))
    got = np.array([r["x"] for r in forecast.apply_sequence_scaler(df, fitted).orderBy("k").collect()])
    flat = x[:5].reshape(-1, 2)
    np.testing.assert_allclose(got, (x - flat.mean(0)) / np.where(flat.std(0) > 1e-12, flat.std(0), 1.0), atol=1e-12)


def test_mackinnon_p():
    assert stationarity.mackinnon_p(-2.86) == pytest.approx(0.05, abs=1e-3)  # published 5 % value
    assert stationarity.mackinnon_p(-3.43) == pytest.approx(0.01, abs=1e-3)  # published 1 % value
    assert stationarity.mackinnon_p(3.0) == 1.0 and stationarity.mackinnon_p(-20.0) == 0.0
    assert stationarity.mackinnon_p(-1.6100001) == pytest.approx(stationarity.mackinnon_p(-1.6099999), abs=2e-3)
    assert pd.Series([stationarity.mackinnon_p(t / 10) for t in range(-50, 25)]).is_monotonic_increasing
