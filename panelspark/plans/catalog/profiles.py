"""Profile queries: missingness, distribution, variance, correlation, autocorrelation, schema, stationarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.aggregates import HOURS, mean_series
from panelspark.operators.profile import (
    acf, all_missing_by_date, completeness, corr_with_target, describe_adjusted, distribution_summary,
    distribution_summary_by, histogram, lag_autocorr, mean_by_group, missing_rate_by, missing_rates, missing_rates_by_entity, overall_missing_rate,
    row_missing_histogram, series_summary, variance_split,
)
from panelspark.operators.stationarity import adf_test
from panelspark.operators.windows import next_label
from panelspark.plans.catalog.panel import WIDE, wide
from panelspark.plans.catalog.registry import (
    DAILY, DAILY_TYPES, EVENT_TYPES, daily, daily_types, query, rounded, table,
)
from panelspark.session import materialise
from panelspark.sources.schema import schema_report

TYPE_NULLS = " + ".join(f'("{t}" IS NULL)::INT' for t in EVENT_TYPES)


@query("missing_rates_by_entity", f"""
WITH {DAILY_TYPES} SELECT user_id, MIN(date) FILTER (click IS NOT NULL) AS first_day, COUNT(*) AS n_rows,
""" + ", ".join(f'ROUND(AVG(("{t}" IS NULL)::INT), 6) AS "{t}"' for t in EVENT_TYPES) + " FROM daily_types GROUP BY 1")
def missing_rates_by_entity_query(spark, sf_dir):
    rows = daily_types(spark, sf_dir).withColumn("first_day", F.when(F.col("click").isNotNull(), F.col("date")))
    out = missing_rates_by_entity(rows, "user_id", EVENT_TYPES, ["first_day"], order=["date"])
    return rounded(out, *EVENT_TYPES, digits=6)


@query("missing_rates_by_column", f"""
WITH {DAILY_TYPES}, r AS (SELECT 0.0::DOUBLE AS user_id, 0.0::DOUBLE AS date,
""" + ", ".join(f'AVG(("{t}" IS NULL)::INT) AS "{t}"' for t in EVENT_TYPES) + """ FROM daily_types)
SELECT "column", ROUND(missing_rate, 6) AS missing_rate FROM (UNPIVOT r ON user_id, date,
""" + ", ".join(f'"{t}"' for t in EVENT_TYPES) + """ INTO NAME "column" VALUE missing_rate)""")
def missing_rates_by_column(spark, sf_dir):
    return rounded(missing_rates(daily_types(spark, sf_dir)), "missing_rate", digits=6)


@query("overall_missing_rate", f"WITH {DAILY_TYPES} SELECT ROUND(AVG(({TYPE_NULLS}) / 7.0::DOUBLE), 6) AS missing_rate FROM daily_types")
def overall_missing_rate_query(spark, sf_dir):
    return rounded(overall_missing_rate(daily_types(spark, sf_dir)), "missing_rate", digits=6)


@query("row_missing_hist", f"WITH {DAILY_TYPES} SELECT CAST({TYPE_NULLS} AS INTEGER) AS n_missing, COUNT(*) AS n_rows FROM daily_types GROUP BY 1")
def row_missing_hist(spark, sf_dir):
    return row_missing_histogram(daily_types(spark, sf_dir))


@query("missing_by_entity", f"WITH {DAILY_TYPES} SELECT user_id, ROUND(AVG({TYPE_NULLS}) / 7, 6) AS missing_rate FROM daily_types GROUP BY 1")
def missing_by_entity(spark, sf_dir):
    return rounded(missing_rate_by(daily_types(spark, sf_dir), "user_id"), "missing_rate", digits=6)


@query("missing_by_date", f"WITH {DAILY_TYPES} SELECT date, ROUND(AVG({TYPE_NULLS}) / 7, 6) AS missing_rate FROM daily_types GROUP BY 1")
def missing_by_date(spark, sf_dir):
    return rounded(missing_rate_by(daily_types(spark, sf_dir), "date"), "missing_rate", digits=6)


@query("all_missing_days", f"""
WITH {WIDE} SELECT date, CAST(SUM(({' AND '.join(f'{h} IS NULL' for h in HOURS[:12])})::INT) AS BIGINT) AS n_all_missing
FROM wide GROUP BY 1
""")
def all_missing_days(spark, sf_dir):
    return all_missing_by_date(wide(spark, sf_dir), "date", HOURS[:12])


@query("series_summary", f"""
WITH {DAILY}, s AS (SELECT date, AVG(value) AS v FROM daily GROUP BY 1)
SELECT COUNT(*) AS n, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std, ROUND(MIN(v), 6) AS min,
       ROUND(quantile_cont(v, 0.5), 6) AS p50, ROUND(quantile_cont(v, 0.9), 6) AS p90,
       ROUND(quantile_cont(v, 0.95), 6) AS p95, ROUND(quantile_cont(v, 0.99), 6) AS p99, ROUND(MAX(v), 6) AS max FROM s
""")
def series_summary_query(spark, sf_dir):
    series = mean_series(daily(spark, sf_dir), "date", "value", "v")
    return rounded(series_summary(series, "v"), "mean", "std", "min", "max", "p50", "p90", "p95", "p99", digits=6)


@query("distribution_summary", """
SELECT COUNT(*) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std, MIN(value) AS min,
       ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.9), 6) AS p90,
       ROUND(quantile_cont(value, 0.95), 6) AS p95, ROUND(quantile_cont(value, 0.99), 6) AS p99, MAX(value) AS max
FROM events
""")
def distribution_summary_query(spark, sf_dir):
    out = distribution_summary(table(spark, sf_dir, "events"), "value")
    return rounded(out, "mean", "std", "p50", "p90", "p95", "p99", digits=6)


@query("distribution_summary_by", """
SELECT o_custkey % 25 AS nation_id, COUNT(*) AS n, ROUND(AVG(o_totalprice), 6) AS mean, ROUND(STDDEV_SAMP(o_totalprice), 6) AS std,
       MIN(o_totalprice) AS min, ROUND(quantile_cont(o_totalprice, 0.5), 6) AS p50,
       ROUND(quantile_cont(o_totalprice, 0.9), 6) AS p90, ROUND(quantile_cont(o_totalprice, 0.95), 6) AS p95,
       ROUND(quantile_cont(o_totalprice, 0.99), 6) AS p99, MAX(o_totalprice) AS max
FROM orders GROUP BY 1
""")
def distribution_summary_by_query(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("nation_id"), "o_totalprice")
    out = distribution_summary_by(materialise(rows, "prices"), ["nation_id"], "o_totalprice")
    return rounded(out, "mean", "std", "p50", "p90", "p95", "p99", digits=6)


@query("moments_adjusted", """
SELECT COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, ROUND(VAR_SAMP(value), 5) AS variance,
       ROUND(SKEWNESS(value), 6) AS skewness, ROUND(KURTOSIS(value), 6) AS kurtosis FROM events
""")
def moments_adjusted(spark, sf_dir):
    out = describe_adjusted(table(spark, sf_dir, "events"), "value")
    return rounded(rounded(out, "mean", "skewness", "kurtosis", digits=6), "variance", digits=5)


@query("region_means", f"""
WITH {DAILY} SELECT user_id % 25 AS region, ROUND(AVG(value), 6) AS mean, ROUND(VAR_SAMP(value), 5) AS variance
FROM daily GROUP BY 1
""")
def region_means(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("region", F.col("user_id") % 25)
    return rounded(rounded(mean_by_group(rows, "region", "value"), "mean", digits=6), "variance", digits=5)


@query("variance_split", f"""
WITH {DAILY}, g AS (SELECT user_id % 25 AS region, AVG(value) AS m, VAR_SAMP(value) AS v FROM daily GROUP BY 1)
SELECT (SELECT ROUND(VAR_SAMP(value), 5) FROM daily) AS overall_variance,
       ROUND(VAR_SAMP(m), 5) AS between_variance, ROUND(AVG(v), 5) AS within_variance FROM g
""")
def variance_split_query(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("region", F.col("user_id") % 25)
    return rounded(variance_split(rows, "region", "value"), "overall_variance", "between_variance", "within_variance", digits=5)


@query("corr_with_next_day", f"""
WITH {DAILY}, t AS (
  SELECT value, CAST(n_hours AS DOUBLE) AS n_hours, CASE WHEN user_id % 3 = 0 THEN value * value END AS partly,
         LEAD(value) OVER (PARTITION BY user_id ORDER BY date) AS label FROM daily),
c AS (SELECT CORR(value, label) AS value, CORR(n_hours, label) AS n_hours,
             CORR(partly, label) AS partly FROM t WHERE label IS NOT NULL)
SELECT "column", ROUND(correlation, 6) AS correlation FROM (
  UNPIVOT c ON value, n_hours, partly INTO NAME "column" VALUE correlation)
""")
def corr_with_next_day(spark, sf_dir):
    labelled = next_label(daily(spark, sf_dir), "user_id", "date", "value")
    rows = labelled.select(
        "value", "n_hours", F.when(F.col("user_id") % 3 == 0, F.col("value") * F.col("value")).alias("partly"),
        F.lit(0.0).alias("zeros"), "label",
    )
    return rounded(corr_with_target(rows, "label"), "correlation", digits=6)


HISTOGRAM = """
WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / {bins})), {bins} - 1)::INT AS bin, lo, (hi - lo) / {bins} AS w
      FROM events CROSS JOIN e)
SELECT bin, ROUND(MIN(lo) + bin * MIN(w), 6) AS bin_start, COUNT(*) AS n FROM b GROUP BY bin
"""


@query("histogram_50", HISTOGRAM.format(bins=50))
def histogram_50(spark, sf_dir):
    return rounded(histogram(table(spark, sf_dir, "events"), "value", 50), "bin_start", digits=6)


@query("histogram_120", HISTOGRAM.format(bins=120))
def histogram_120(spark, sf_dir):
    return rounded(histogram(table(spark, sf_dir, "events"), "value", 120), "bin_start", digits=6)


@query("completeness", f"""
WITH {DAILY} SELECT COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_entities, 30 AS n_days,
ROUND(COUNT(*) / (COUNT(DISTINCT user_id) * 30) * 100, 6) AS completeness_pct FROM daily
""")
def completeness_query(spark, sf_dir):
    return rounded(completeness(daily(spark, sf_dir), "user_id", "2024-01-01", "2024-01-30"), "completeness_pct", digits=6)


@query("schema_report", """
SELECT * FROM (VALUES (1, 'n_nationkey', 'int', '0 | 1 | 2'), (2, 'n_name', 'string', 'NATION_0 | NATION_1 | NATION_2'),
  (3, 'n_regionkey', 'int', (SELECT string_agg(n_regionkey, ' | ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3))
) t(ordinal, "column", "type", preview)
""")
def schema_report_query(spark, sf_dir):
    return schema_report(table(spark, sf_dir, "nation"), order=["n_nationkey"])


def nation_series(spark, sf_dir):
    """Mean order price per nation and day: one long series per nation."""
    return table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % 25).alias("nation_id"), F.to_date("o_orderdate").alias("date")
    ).agg(F.avg("o_totalprice").alias("value"))


NATION_SERIES = """series AS (
  SELECT o_custkey % 25 AS nation_id, CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""


@query("autocorr", f"""
WITH {NATION_SERIES}, l AS (
  SELECT nation_id, value, {", ".join(f"LAG(value, {k}) OVER w AS l{k}" for k in range(1, 15))}
  FROM series WINDOW w AS (PARTITION BY nation_id ORDER BY date))
""" + " UNION ALL ".join(
    f"SELECT nation_id, {k} AS lag, ROUND(CORR(value, l{k}), 6) AS correlation FROM l GROUP BY 1" for k in range(1, 15)
))
def autocorr(spark, sf_dir):
    return rounded(lag_autocorr(nation_series(spark, sf_dir), "nation_id", "date", "value", 14), "correlation", digits=6)


@query("acf", f"""
WITH {NATION_SERIES}, c AS (
  SELECT nation_id, date, value - AVG(value) OVER (PARTITION BY nation_id) AS c FROM series),
l AS (SELECT nation_id, c, {", ".join(f"LAG(c, {k}) OVER w AS l{k}" for k in range(21))}
  FROM c WINDOW w AS (PARTITION BY nation_id ORDER BY date))
""" + " UNION ALL ".join(
    f"SELECT nation_id, {k} AS lag, ROUND(SUM(c * l{k}) / SUM(c * c), 6) AS acf FROM l GROUP BY 1" for k in range(21)
))
def acf_query(spark, sf_dir):
    return rounded(acf(nation_series(spark, sf_dir), "nation_id", "date", "value", 20), "acf", digits=6)


@query("adf")
def adf(spark, sf_dir):
    out = adf_test(nation_series(spark, sf_dir), "nation_id", "date", "value")
    return rounded(out, "adf_statistic", "p_value", digits=6)
