"""Augmented Dickey-Fuller test of daily series, with a constant and the lag order chosen by AIC.

The regression of the difference on the level, past differences and a constant needs only a triangular factor of
its rows. Spark computes one per number of past differences available, so that every lag order finds the
factor of its own sample; all lag orders are then read off one factor per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.factors import as_factor, factor_rows, reduced
from panelspark.operators.windows import checked_days, series
from panelspark.session import spread

# MacKinnon's response surface for the p-value with a constant and one variable.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = [2.1659, 1.4412, 0.038269]
LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]

RESULT = ["adf_statistic", "p_value", "used_lag", "n_obs"]


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = SMALL_P if tau <= TAU_STAR else LARGE_P
    z = sum(c * tau**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def longest_lag(n: int) -> int:
    """Schwert's rule for the largest lag, kept small enough to leave rows for the fit."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def _regress(r: np.ndarray, n: int, lags: int) -> tuple[float, float, int]:
    """Log-likelihood, t statistic of the level, and number of rows. Columns: 1, level, past changes, change.

    A factor holds the fits of all lag orders: each is its leading block, and what is left of the change below that block
    is the residual. Fails with ValueError where the rows do not determine the fit.
    """
    k = 2 + lags
    if n <= k or len(r) < k:
        raise ValueError("too few rows")
    block = r[:k, :k]
    if (np.abs(block.diagonal()) <= 1e-11 * np.linalg.norm(block, axis=0)).any():
        raise ValueError("dependent columns")
    inverse = np.linalg.inv(block)
    coef = inverse @ r[:k, -1]
    rss = np.square(r[k:, -1]).sum()
    if rss <= 1e-12 * np.square(r[:, -1]).sum():
        raise ValueError("nothing is left to explain")
    t = coef[1] / math.sqrt(rss / (n - k) * np.square(inverse[1]).sum())
    return -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1), t, n


def adf_test(daily: DataFrame, key: str, date: str, value: str, max_lag: int | None = None) -> DataFrame:
    """Statistic, p-value, lag order and rows used, per series.

    A series that cannot be tested (constant, too short, exactly linear) has null for these but n_obs, its rows
    with a predecessor.
    """
    present = daily.where(F.col(value).isNotNull())
    if max_lag is None:
        longest = present.groupBy(key).count().agg(F.max("count")).first()[0] or 0
        max_lag = longest_lag(longest)
    w = series(key, date)
    level = F.lag(value).over(w)
    steps = checked_days(present, key, date).withColumns({"level": level, "change": F.col(value) - level}).where("level is not null")
    pasts = {f"past{k}": F.coalesce(F.lag("change", k).over(w), F.lit(0.0)) for k in range(1, max_lag + 1)}
    rows = steps.withColumns({"_has": F.least(F.row_number().over(w) - 1, F.lit(max_lag)), **pasts})
    factors = factor_rows(rows, [key, "_has"], ["level", *pasts, "change"])

    def test(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].sum()) + 1
        top = min(max_lag, longest_lag(n))

        def sample(lags: int) -> tuple[np.ndarray, int]:
            inside = part[part["_has"] >= lags]
            blocks = [np.zeros((0, max_lag + 3)), *[as_factor(r, max_lag + 3) for r in inside["r"]]]
            return reduced(np.vstack(blocks)), int(inside["n"].sum())

        try:
            common = sample(top)
            scores = {lags: -2 * _regress(*common, lags)[0] + 2 * (lags + 2) for lags in range(top + 1)}
            best = min(scores, key=lambda lags: (scores[lags], lags))
            _, t, rows_used = _regress(*sample(best), best)
            found = [t, mackinnon_p(t), best, rows_used]
        except ValueError:
            found = [None, None, None, n - 1]
        return pd.DataFrame([[part[key].iloc[0], *found]], columns=[key, *RESULT], dtype=object)

    key_type = daily.schema[key].dataType.simpleString()
    tested = spread(factors, key).groupBy(key).applyInPandas(  # max_lag + 1 factors per series
        test, f"`{key}` {key_type}, adf_statistic double, p_value double, used_lag int, n_obs long"
    )
    every = daily.select(F.col(key).alias("_key")).distinct()  # a series of one row has no moments
    same = F.col("_key").eqNullSafe(tested[key])
    return every.join(tested, same, "left").select(
        F.col("_key").alias(key), *RESULT[:3], F.coalesce("n_obs", F.lit(0).cast("long")).alias("n_obs"))
