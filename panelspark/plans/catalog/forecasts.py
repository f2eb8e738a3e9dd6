"""Forecast queries: scaling, baselines, metrics, losses, category index, per-entity LASSO."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.aggregates import rank_by
from panelspark.operators.forecast import (
    apply_scaler, baselines, category_index, fit_scaler, huber_loss, l1_loss, metrics, permutation_importance,
    weighted_l1,
)
from panelspark.operators.lasso import coefficient_table, fit_lasso_by, model_metrics, number_folds, score_linear
from panelspark.operators.moments import moment_rows
from panelspark.operators.ordering import ordered_index
from panelspark.operators.windows import add_lags, next_label, panel_features, time_split_by
from panelspark.plans.catalog.features import SEQ_LEN, user_sequences
from panelspark.plans.catalog.profiles import nation_series
from panelspark.plans.catalog.registry import DAILY, daily, query, rounded
from panelspark.session import materialise, scratch_path
from panelspark.sources.sinks import write_metrics

CUT = "2024-01-24"


@query("standardize", f"""
WITH {DAILY}, s AS (
  SELECT AVG(value) AS m, STDDEV_POP(value) AS sd, AVG(n_hours) AS hm, STDDEV_POP(n_hours) AS hsd
  FROM daily WHERE date <= DATE '{CUT}')
SELECT user_id, date, ROUND((value - m) / sd, 6) AS value, ROUND((n_hours - hm) / hsd, 6) AS n_hours,
       0.0::DOUBLE AS flat FROM daily CROSS JOIN s
""")
def standardize(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("flat", F.lit(3.0))
    stats = fit_scaler(rows.where(F.col("date") <= F.lit(CUT).cast("date")), ["value", "n_hours", "flat"])
    return rounded(apply_scaler(rows, stats, ["value", "n_hours", "flat"]), "value", "n_hours", "flat", digits=6)


PERSISTENCE = f"""
WITH {DAILY}, p AS (SELECT * FROM (
  SELECT user_id, date, value AS y_hat, LEAD(value) OVER (PARTITION BY user_id ORDER BY date) AS y FROM daily)
  WHERE y IS NOT NULL)
"""


def persistence(spark, sf_dir):
    labelled = next_label(daily(spark, sf_dir), "user_id", "date", "value", "y")
    return labelled.withColumnRenamed("value", "y_hat")


METRICS = """COUNT(*) AS n, ROUND(AVG(abs(y - y_hat)), 6) AS mae, ROUND(sqrt(AVG((y - y_hat) * (y - y_hat))), 6) AS rmse,
  ROUND(CASE WHEN VAR_POP(y) = 0 THEN 0.0 ELSE 1 - AVG((y - y_hat) * (y - y_hat)) / VAR_POP(y) END, 5) AS r2,
  ROUND(AVG(abs(y - y_hat) / greatest(abs(y), 1e-6)) * 100, 5) AS mape_pct,
  ROUND(AVG(2 * abs(y - y_hat) / greatest(abs(y) + abs(y_hat), 1e-6)) * 100, 5) AS smape_pct,
  ROUND(CASE WHEN VAR_POP(y) = 0 OR VAR_POP(y_hat) = 0 THEN 0.0 ELSE CORR(y, y_hat) END, 6) AS pearson_r"""


def rounded_metrics(df):
    return rounded(rounded(df, "mae", "rmse", "pearson_r", digits=6), "r2", "mape_pct", "smape_pct", digits=5)


@query("metrics", f"{PERSISTENCE} SELECT {METRICS} FROM p")
def metrics_query(spark, sf_dir):
    return rounded_metrics(metrics(persistence(spark, sf_dir), "y", "y_hat"))


@query("metrics_by_region", f"{PERSISTENCE} SELECT user_id % 25 AS region, {METRICS} FROM p GROUP BY 1")
def metrics_by_region(spark, sf_dir):
    rows = persistence(spark, sf_dir).withColumn("region", F.col("user_id") % 25)
    return rounded_metrics(metrics(rows, "y", "y_hat", by="region"))


@query("metrics_ranked", f"""
{PERSISTENCE}, m AS (SELECT user_id % 25 AS region, {METRICS} FROM p GROUP BY 1)
SELECT region, r2, mae, ROW_NUMBER() OVER (ORDER BY r2 DESC, region) AS rank FROM m
""")
def metrics_ranked(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    write_metrics(metrics_by_region(spark, sf_dir), path)
    stored = spark.read.schema("region long, r2 double, mae double").json(path)
    ranked = ordered_index(stored, F.desc("r2"), "region", name="rank")
    return rank_by(ranked.withColumn("rank", F.col("rank") + 1), "r2", tie=["region"])


BASELINES = f"""
WITH {DAILY}, l AS (SELECT *, LEAD(value) OVER (PARTITION BY user_id ORDER BY date) AS label FROM daily),
k AS (SELECT *, value::FLOAT::DOUBLE AS v, ROW_NUMBER() OVER w AS rn FROM l WHERE label IS NOT NULL
      WINDOW w AS (PARTITION BY user_id ORDER BY date)),
b AS (SELECT user_id, date AS end_date, label::FLOAT AS y, v AS persistence, rn,
      AVG(v) OVER (PARTITION BY user_id ORDER BY date ROWS {SEQ_LEN - 1} PRECEDING) AS window_mean FROM k)
"""


@query("baselines", BASELINES + f"""
SELECT user_id, end_date, y, persistence, ROUND(window_mean, 6) AS window_mean FROM b WHERE rn >= {SEQ_LEN}
""")
def baselines_query(spark, sf_dir):
    out = baselines(user_sequences(spark, sf_dir), "x", 0).drop("x")
    return rounded(out, "window_mean", digits=6)


@query("baseline_scores", BASELINES + f"""
SELECT name, ROUND(AVG(abs(y - v)), 5) AS mae, ROUND(sqrt(AVG((y - v) * (y - v))), 5) AS rmse
FROM (SELECT y::DOUBLE AS y, 'persistence' AS name, persistence AS v FROM b WHERE rn >= {SEQ_LEN}
      UNION ALL SELECT y::DOUBLE, 'window_mean', window_mean FROM b WHERE rn >= {SEQ_LEN}) GROUP BY 1
""")
def baseline_scores(spark, sf_dir):
    rows = baselines(user_sequences(spark, sf_dir), "x", 0).withColumn("y", F.col("y").cast("double"))
    long = rows.unpivot(["y"], ["persistence", "window_mean"], "name", "y_hat")
    return rounded(metrics(long, "y", "y_hat", by="name").select("name", "mae", "rmse"), "mae", "rmse", digits=5)


@query("l1_loss", f"{PERSISTENCE} SELECT ROUND(AVG(abs(y - y_hat)), 6) AS l1 FROM p")
def l1_query(spark, sf_dir):
    return rounded(l1_loss(persistence(spark, sf_dir), "y", "y_hat"), "l1", digits=6)


@query("huber", f"""
{PERSISTENCE}, e AS (SELECT abs(ln(1 + greatest(y, 0)) - ln(1 + greatest(y_hat, 0))) AS e FROM p)
SELECT ROUND(AVG(CASE WHEN e < 0.5 THEN e * e / (2 * 0.5) ELSE e - 0.5 / 2 END), 6) AS huber FROM e
""")
def huber(spark, sf_dir):
    rows = persistence(spark, sf_dir).select(F.log1p("y").alias("y"), F.log1p("y_hat").alias("y_hat"))
    return rounded(huber_loss(rows, "y", "y_hat", beta=0.5), "huber", digits=6)


@query("weighted_l1", f"""
{PERSISTENCE}, q AS (SELECT quantile_cont(y, 0.9) AS p90 FROM p WHERE date <= DATE '{CUT}')
SELECT ROUND(AVG(abs(y - y_hat) * least(greatest(1.0 + 2.0 * y / p90, 1.0), 5.0)), 6) AS weighted_l1 FROM p CROSS JOIN q
""")
def weighted_l1_query(spark, sf_dir):
    rows = persistence(spark, sf_dir)
    train = rows.where(F.col("date") <= F.lit(CUT).cast("date"))
    return rounded(weighted_l1(rows, train, "y", "y_hat", alpha=2.0), "weighted_l1", digits=6)


@query("category_index", f"""
WITH {DAILY}, t AS (SELECT DISTINCT user_id FROM daily WHERE date <= DATE '2024-01-03'),
k AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY user_id) - 1 AS idx FROM t)
SELECT d.user_id, d.date, COALESCE(k.idx, (SELECT COUNT(*) FROM k)) AS index FROM daily d LEFT JOIN k ON d.user_id = k.user_id
""")
def category_index_query(spark, sf_dir):
    rows = daily(spark, sf_dir).select("user_id", "date")
    return category_index(rows.where("date <= date'2024-01-03'"), rows, "user_id")


def nation_features(spark, sf_dir):
    """Labelled features of the nation series."""
    labelled = next_label(nation_series(spark, sf_dir), "nation_id", "date", "value")
    return panel_features(
        labelled, "nation_id", "date", {"value": [1, 2, 3, 7]}, {"value": [3, 7]}, {"value": [1]}
    ).drop("day_of_year")


FEATURES = [
    "value", "value_lag_1", "value_lag_2", "value_lag_3", "value_lag_7", "value_roll_mean_3", "value_roll_std_3",
    "value_roll_mean_7", "value_roll_std_7", "sin_doy", "cos_doy",
]


def nation_models(spark, sf_dir):
    return fit_lasso_by(nation_features(spark, sf_dir), "nation_id", "date", FEATURES, "label")


# Prices are divided by a prime, so that no sum lies on the edge between two rounded values.
PAIRS = ["one", "value", "past", "label"]


@query("fold_moments", """
WITH series AS (
  SELECT o_custkey % 25 AS nation_id, CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) / 99991 AS value
  FROM orders GROUP BY 1, 2),
f AS (SELECT *, 1 AS one, LAG(value) OVER w AS past, LEAD(value) OVER w AS label FROM series
      WINDOW w AS (PARTITION BY nation_id ORDER BY date)),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation_id ORDER BY date) - 1 AS i,
      CAST(floor(COUNT(*) OVER (PARTITION BY nation_id) * 0.8::DOUBLE) AS BIGINT) AS n
      FROM f WHERE past IS NOT NULL AND label IS NOT NULL),
k AS (SELECT *, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM t WHERE i < n)
SELECT nation_id, fold, """ + ", ".join(
    f"ROUND(SUM({a} * {b})::DOUBLE, 8) AS {a}_{b}" for i, a in enumerate(PAIRS) for b in PAIRS[i:]
) + " FROM k GROUP BY 1, 2")
def fold_moments(spark, sf_dir):
    series = nation_series(spark, sf_dir).withColumn("value", F.col("value") / 99991)
    lagged = add_lags(next_label(series, "nation_id", "date", "value"), "nation_id", "date", {"value": [1]})
    rows = time_split_by(lagged.dropna(), "nation_id", "date")
    train = number_folds(rows, "nation_id", "date", 5)
    sums = moment_rows(train, ["nation_id", "fold"], ["value", "value_lag_1", "label"])
    cells = [
        F.max(F.when(F.col("i") == i, F.col("s")[j])).alias(f"{a}_{PAIRS[j]}")
        for i, a in enumerate(PAIRS) for j in range(i, len(PAIRS))
    ]
    wide = sums.groupBy("nation_id", "fold").agg(*cells)
    return rounded(wide, *wide.columns[2:], digits=8)


@query("lasso_by_region")
def lasso_by_region(spark, sf_dir):
    models, rows = nation_models(spark, sf_dir)
    fitted = materialise(models, "models")
    return model_metrics(rows, fitted, "nation_id", FEATURES, "label")


@query("lasso_coefficients")
def lasso_coefficients(spark, sf_dir):
    return coefficient_table(nation_models(spark, sf_dir)[0], "nation_id", FEATURES)


@query("lasso_selected")
def lasso_selected(spark, sf_dir):
    return coefficient_table(nation_models(spark, sf_dir)[0], "nation_id", FEATURES, selected=True)


@query("lasso_scores")
def lasso_scores(spark, sf_dir):
    models, rows = nation_models(spark, sf_dir)
    return score_linear(rows, models, "nation_id", FEATURES).select("nation_id", "date", "split", "label", "y_hat")


@query("permutation_importance")
def permutation_importance_query(spark, sf_dir):
    models, rows = nation_models(spark, sf_dir)
    fitted = materialise(models, "models")
    scored = score_linear(rows.where("split = 'test'"), fitted, "nation_id", FEATURES)
    return permutation_importance(scored, fitted, "nation_id", "date", FEATURES, "label")
