"""Scaling, baselines, metrics, losses and permutation importance for next-day forecasts."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalars import as_col, clamp, pearson
from panelspark.operators.ordering import exact_quantiles, ordered_index

EPSILON = 1e-6


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a column without spread gets deviation 1."""
    stats = []
    for c in cols:
        spread = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}_mean"), F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}_std")]
    return train.agg(*stats)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    fitted = df.withColumn("_fit", stats.select(F.struct(*stats.columns)).scalar())
    return fitted.withColumns(
        {c: (F.col(c) - F.col("_fit")[f"{c}_mean"]) / F.col("_fit")[f"{c}_std"] for c in cols}
    ).drop("_fit")


def fit_sequence_scaler(train: DataFrame, steps: str = "x") -> DataFrame:
    """Per feature the mean and population deviation over all steps of all sequences; one row of two arrays.

    A row of the panel counts once for every sequence that holds it. A feature without spread gets deviation 1.
    """
    cells = train.select(F.explode(steps).alias("_step")).select(F.posexplode("_step").alias("_feature", "_value"))
    value = F.col("_value").cast("double")
    spread = F.stddev_pop(value)
    stats = cells.groupBy("_feature").agg(
        F.avg(value).alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("std"))
    ordered = F.array_sort(F.collect_list(F.struct("_feature", "mean", "std")))  # one entry per feature
    return stats.agg(ordered.alias("_all")).select(F.col("_all.mean").alias("mean"), F.col("_all.std").alias("std"))


def apply_sequence_scaler(df: DataFrame, stats: DataFrame, steps: str = "x") -> DataFrame:
    fitted = df.withColumn("_fit", stats.select(F.struct("mean", "std")).scalar())

    def scaled(step: Column) -> Column:
        return F.transform(
            F.arrays_zip(step.alias("v"), F.col("_fit.mean").alias("m"), F.col("_fit.std").alias("s")),
            lambda p: (p["v"] - p["m"]) / p["s"])

    return fitted.withColumn(steps, F.transform(steps, scaled)).drop("_fit")


def baselines(df: DataFrame, steps: str, feature: int) -> DataFrame:
    """Forecasts from each sequence alone: the last value of a feature, and its mean over the window."""
    values = F.transform(steps, lambda step: step[feature].cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(steps)
    return df.withColumns({"persistence": F.element_at(values, -1), "window_mean": mean})


def metrics(
    df: DataFrame, y: str, y_hat: str, by: str | Sequence[str] | None = None, signed_mape: bool = False
) -> DataFrame:
    """MAE, RMSE, R2, MAPE, sMAPE and Pearson r, over all rows or per group.

    R2 and r are 0 where nothing varies. ``signed_mape`` bounds the denominator of MAPE from below without
    taking its absolute value first.
    """
    error = F.col(y) - F.col(y_hat)
    floor = F.lit(EPSILON)
    base = F.greatest(F.col(y) if signed_mape else F.abs(y), floor)
    both = F.greatest(F.abs(y) + F.abs(y_hat), floor)
    spread = F.var_pop(y)
    groups = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread == 0, 0.0).otherwise(1 - F.try_divide(F.avg(error * error), spread)).alias("r2"),
        (F.avg(F.abs(error / base)) * 100).alias("mape_pct"),
        (F.avg(F.abs(error) * 2 / both) * 100).alias("smape_pct"),
        F.coalesce(pearson(y, y_hat), F.lit(0.0)).alias("pearson_r"),
    )


def category_index(train: DataFrame, df: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Position of each category among the sorted categories of ``train``; unseen ones share the next number."""
    known = ordered_index(train.select(col).where(F.col(col).isNotNull()).distinct(), col, name=name)
    size = known.agg(F.count("*")).scalar()
    return df.join(known, col, "left").withColumn(name, F.coalesce(F.col(name), size))


def l1_loss(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(y_hat))).alias("l1"))


def huber_loss(df: DataFrame, y: str, y_hat: str, beta: float = 1.0) -> DataFrame:
    """Smooth L1: quadratic below ``beta``, linear above."""
    error = F.abs(F.col(y) - F.col(y_hat))
    return df.agg(F.avg(F.when(error < beta, error * error / (2 * beta)).otherwise(error - beta / 2)).alias("huber"))


def high_value_weight(y: Column | str, p90: float, alpha: float = 2.0) -> Column:
    """Weight that grows with the value, between 1 and 1 + 2 alpha."""
    return clamp(F.lit(1.0) + F.lit(alpha) * as_col(y) / F.lit(max(p90, EPSILON)), 1.0, 1.0 + 2.0 * alpha)


def weighted_l1(df: DataFrame, train: DataFrame, y: str, y_hat: str, alpha: float = 2.0) -> DataFrame:
    """Absolute error weighted by the value relative to the 90th percentile of the training targets."""
    p90 = exact_quantiles(train, y, [0.9])[0]
    return df.agg(F.avg(F.abs(F.col(y) - F.col(y_hat)) * high_value_weight(y, p90, alpha)).alias("weighted_l1"))


def permutation_importance(
    scored: DataFrame, models: DataFrame, entity: str, date: str, features: Sequence[str], y: str, seed: int = 42
) -> DataFrame:
    """Increase of the mean absolute error when one feature is exchanged between rows.

    ``scored`` holds the test rows with ``y_hat``. The rows are put in a random order once, by md5 of entity, day and seed,
    and each row is given the values of the row a fixed distance further on, so that no row keeps its own and every
    value is used once. The entity itself is exchanged in the same way, which exchanges the models.
    """
    place = F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.col(date).cast("string"), F.lit(str(seed))))
    x = F.array(*[F.col(c).cast("double") for c in features])
    narrow = scored.select(
        place.alias("_place"), entity, date, F.col(y).alias("_y"), "y_hat", x.alias("_x"))
    rows = ordered_index(narrow, "_place", entity, date, name="_row").drop("_place", date)
    n = rows.count()
    step = exchange_distance(seed, n)
    fitted = models.select(entity, "intercept", "coef", "mean", "spread")
    donors = rows.select(
        ((F.col("_row") + (n - step)) % max(n, 1)).alias("_row"), F.col(entity).alias("_donor"), F.col("_x").alias("_other"))
    theirs = fitted.select(
        F.col(entity).alias("_donor"), F.struct("intercept", "coef", "mean", "spread").alias("_model"))
    paired = rows.join(donors, "_row").join(fitted, entity).join(theirs, "_donor")
    moved = F.transform(
        F.arrays_zip(F.col("_other").alias("o"), F.col("_x").alias("x"), F.col("coef").alias("c"), F.col("spread").alias("s")),
        lambda p: F.abs(F.col("_y") - F.col("y_hat") - p["c"] / p["s"] * (p["o"] - p["x"])))
    parts = F.transform(
        F.arrays_zip(F.col("_x").alias("x"), F.col("_model.mean").alias("m"), F.col("_model.spread").alias("s"),
                     F.col("_model.coef").alias("c")),
        lambda p: (p["x"] - p["m"]) / p["s"] * p["c"])
    swapped = F.col("_model.intercept") + F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    errors = paired.select(
        F.abs(F.col("_y") - F.col("y_hat")).alias("_base"),
        F.concat(moved, F.array(F.abs(F.col("_y") - swapped))).alias("_new"))
    names = [*features, entity]
    rises = errors.agg(*[
        F.struct(F.lit(name).alias("feature"), (F.avg(F.col("_new")[i]) - F.avg("_base")).alias("mae_increase")).alias(f"_{i}")
        for i, name in enumerate(names)])
    long = rises.select(F.inline(F.array(*[f"_{i}" for i in range(len(names))])))
    return long.where("mae_increase is not null").orderBy(F.desc("mae_increase"), "feature")


def exchange_distance(seed: int, n: int) -> int:
    """How far on the exchanged values come from: a fixed pseudo-random number in [1, n)."""
    return 1 + zlib.crc32(str(seed).encode()) % (n - 1) if n > 1 else 0
