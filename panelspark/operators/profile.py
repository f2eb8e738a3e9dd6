"""Profiles of a panel: missingness, distribution, variance, correlation and autocorrelation.

Whole-table profiles are single aggregates with map-side combine; order statistics of large columns go
through the distributed selection in ``ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.names import numeric_columns
from panelspark.functions.scalars import null_safe, pearson, quoted, valid_count
from panelspark.operators.ordering import exact_quantiles
from panelspark.operators.quantiles import grouped_quantiles
from panelspark.operators.windows import checked_days, series

QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def _null_rate(c: str) -> Column:
    return F.expr(f"avg(int({quoted(c)} is null)) as {quoted(c)}")


def _null_count(cols: Sequence[str]) -> Column:
    return F.lit(len(cols)) - valid_count(cols)


def missing_rates_by_entity(
    df: DataFrame, key: str, cols: Sequence[str], id_cols: Sequence[str] = (), order: Sequence[Column | str] = ()
) -> DataFrame:
    """Rows and null rate per column for each entity, with the first attribute that is not null."""
    names = df.columns
    present = [c for c in cols if c in names]
    if not present:
        raise ValueError(f"none of {list(cols)} among columns {names}")
    ids = [c for c in id_cols if c in names]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*(order or [c])))).alias(c) for c in ids]
    rates = [_null_rate(c) for c in present]
    return df.groupBy(key).agg(*first, F.count("*").alias("n_rows"), *rates).orderBy(F.desc("n_rows"), key)


def missing_rates(df: DataFrame) -> DataFrame:
    rates = df.agg(*[_null_rate(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column", "missing_rate").orderBy(F.desc("missing_rate"), "column")


def overall_missing_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(_null_count(df.columns) / len(df.columns)).alias("missing_rate"))


def row_missing_histogram(df: DataFrame) -> DataFrame:
    per_row = df.select(_null_count(df.columns).alias("n_missing"))
    return per_row.groupBy("n_missing").agg(F.count("*").alias("n_rows")).orderBy("n_missing")


def missing_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Mean over all columns of the null rate, per key; the key's own column counts as one of them."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        (F.avg(_null_count(df.columns)) / len(df.columns)).alias("missing_rate")
    )


def all_missing_by_date(df: DataFrame, date: str, cols: Sequence[str]) -> DataFrame:
    empty = (valid_count(cols) == 0).cast("long")
    return df.where(F.col(date).isNotNull()).groupBy(date).agg(F.sum(empty).alias("n_all_missing")).orderBy(date)


def _summary(df: DataFrame, value: str) -> list[Column]:
    return [
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def distribution_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quantiles of a column of any length."""
    quantiles = exact_quantiles(df, value, list(QUANTILES.values()))
    one_row = df.agg(*_summary(df, value))
    return one_row.withColumns({name: F.lit(q).cast("double") for name, q in zip(QUANTILES, quantiles)})


def distribution_summary_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``distribution_summary`` of every group, of any size; a group without values has nulls."""
    whole = df.groupBy(*keys).agg(*_summary(df, value))
    found = grouped_quantiles(df, keys, value, QUANTILES).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    return whole.join(found, null_safe(whole, keys, found), "left").select(*[whole[c] for c in whole.columns], *QUANTILES)


def series_summary(daily: DataFrame, value: str) -> DataFrame:
    """``distribution_summary`` of a daily series."""
    return distribution_summary(daily, value)


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, the quartiles exact."""
    quartiles = exact_quantiles(df, value, [0.25, 0.5, 0.75])
    named = {name: F.lit(q).cast("double") for name, q in zip(("p25", "p50", "p75"), quartiles)}
    return df.agg(*_summary(df, value)).withColumns(named)


def describe_adjusted(df: DataFrame, value: str) -> DataFrame:
    """Variance with bias-adjusted skewness and excess kurtosis, from the population forms."""
    n = F.col("n").cast("double")
    base = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"),
        F.skewness(value).alias("_g1"), F.kurtosis(value).alias("_g2"),
    )
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    return base.withColumns({"skewness": skew, "kurtosis": kurt}).drop("_g1", "_g2")


def mean_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    known = df.where(F.col(group).isNotNull())
    return known.groupBy(group).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance")).orderBy("mean", group)


def variance_split(df: DataFrame, group: str, value: str) -> DataFrame:
    """Overall variance, variance of the group means, and mean of the group variances."""
    whole = df.agg(F.var_samp(value).alias("v")).scalar()
    groups = mean_by_group(df, group, value)
    parts = groups.agg(F.var_samp("mean").alias("between_variance"), F.avg("variance").alias("within_variance"))
    return parts.select(whole.alias("overall_variance"), "between_variance", "within_variance")


def corr_with_target(df: DataFrame, target: str) -> DataFrame:
    """Pearson correlation of every numeric column with the target, over rows that hold both.

    Columns that are 0 throughout are left out.
    """
    rows = df.where(F.col(target).isNotNull())
    cols = numeric_columns(rows, exclude=[target])
    found = rows.agg(
        *[F.struct(
            pearson(c, target).alias("r"), F.bool_and(F.coalesce(F.col(c) == 0, F.lit(False))).alias("zero")
        ).alias(c) for c in cols]
    )
    long = found.unpivot([], cols, "column", "_x")
    return (
        long.where(~F.col("_x")["zero"])
        .select("column", F.col("_x")["r"].alias("correlation"))
        .orderBy(F.desc("correlation"), "column")
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the last bin is closed."""
    present = df.where(F.col(value).isNotNull())
    ends = present.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    spread = present.select(F.col(value).alias("_v"), ends.alias("_ends"))
    low, high = F.col("_ends")["low"], F.col("_ends")["high"]
    width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0))
    slot = F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1).cast("long"))
    counts = spread.withColumn("bin", slot).groupBy("bin").agg(
        F.count("*").alias("n"), F.min(low).alias("_low"), F.min(width).alias("_width")
    )
    return counts.select(
        F.col("bin").cast("int").alias("bin"), (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"), "n"
    ).orderBy("bin")


def completeness(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Rows present as a percentage of entities times days in the closed range."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    counts = df.agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("n_entities"))
    share = F.try_divide(F.col("n_rows") * F.lit(100.0), F.col("n_entities") * F.col("n_days"))
    return counts.withColumn("n_days", days).withColumn("completeness_pct", share)


def observe_step(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and remaining nulls of a step while it runs, without another scan."""
    seen = Observation(name)
    nulls = F.sum(_null_count(df.columns)).alias("n_nulls")
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), nulls), seen


def audit_table(df: DataFrame, steps: Sequence[tuple[str, int, Observation]]) -> DataFrame:
    """One row per observed step that has run: rows, columns, remaining nulls."""
    rows = [(name, seen.get["n_rows"], width, seen.get["n_nulls"] or 0) for name, width, seen in steps]
    return df.sparkSession.createDataFrame(rows, "step string, n_rows long, n_columns int, n_nulls long")


def lag_autocorr(daily: DataFrame, key: str, date: str, value: str, lags: int = 14) -> DataFrame:
    """Pearson correlation of each series with itself 1 to ``lags`` rows earlier, over rows that hold both."""
    w = series(key, date)
    shifted = checked_days(daily, key, date).withColumns({f"_l{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)})
    wide = shifted.groupBy(key).agg(*[pearson(value, f"_l{k}").alias(str(k)) for k in range(1, lags + 1)])
    long = wide.unpivot([key], [str(k) for k in range(1, lags + 1)], "lag", "correlation")
    return long.withColumn("lag", F.col("lag").cast("int"))


def acf(daily: DataFrame, key: str, date: str, value: str, nlags: int = 20) -> DataFrame:
    """Autocorrelation with the whole series' mean and length in every lag; nulls are left out first."""
    w = series(key, date)
    present = checked_days(daily.where(F.col(value).isNotNull()), key, date)
    centred = present.withColumn("_c", F.col(value) - F.avg(value).over(W.partitionBy(key)))
    products = centred.withColumns({f"_p{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(nlags + 1)})
    wide = products.groupBy(key).agg(
        F.count("*").alias("_n"), *[F.try_divide(F.sum(f"_p{k}"), F.sum("_p0")).alias(str(k)) for k in range(nlags + 1)]
    )
    long = wide.unpivot([key, "_n"], [str(k) for k in range(nlags + 1)], "lag", "acf")
    return long.withColumn("lag", F.col("lag").cast("int")).where(F.col("lag") < F.col("_n")).drop("_n")
