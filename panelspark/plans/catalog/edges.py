"""Queries on awkward input: first rows that are not the least, null days, differing headers, closed-form models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.aggregates import HOURS, numeric_mean_by, rank_by
from panelspark.operators.forecast import (
    apply_sequence_scaler, exchange_distance, fit_sequence_scaler, metrics, permutation_importance,
)
from panelspark.operators.geo import station_coordinates
from panelspark.operators.joins import attach_region_by_site, attach_station_region, calendar_spine, fill_region
from panelspark.operators.lasso import coefficient_table, fit_lasso_by, model_metrics, score_linear
from panelspark.operators.profile import all_missing_by_date, describe
from panelspark.operators.stationarity import adf_test
from panelspark.operators.windows import next_label, time_split
from panelspark.plans.catalog.features import SEQ_LEN, user_sequences
from panelspark.plans.catalog.forecasts import PERSISTENCE, METRICS, persistence, rounded_metrics
from panelspark.plans.catalog.panel import WIDE, wide
from panelspark.plans.catalog.profiles import nation_series
from panelspark.plans.catalog.registry import DAILY, SPINE_END, SPINE_START, daily, query, rounded, table
from panelspark.session import materialise, scratch_path
from panelspark.sources.files import read_tagged
from panelspark.sources.pages import station_ids
from panelspark.sources.sinks import write_table


# First rows. Every nation has many lookup rows; the last customer's comes first.

def customer_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("station_id"), F.concat(F.lit(" "), "c_name").alias("region"),
        (-F.col("c_custkey")).alias("row"))


FIRST_NAME = "(SELECT c_nationkey AS k, arg_max(c_name, c_custkey) AS region FROM customer GROUP BY 1)"


@query("lookup_first_row", f"""
SELECT s_suppkey, s.s_nationkey AS station_id, f.region FROM supplier s LEFT JOIN {FIRST_NAME} f ON f.k = s.s_nationkey
""")
def lookup_first_row(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("station_id"))
    return attach_station_region(suppliers, customer_lookup(spark, sf_dir), order=["row"])


@query("fill_first_row", f"""
SELECT o_orderkey, o_custkey % 25 AS station_id, COALESCE(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, f.region) AS region
FROM orders LEFT JOIN {FIRST_NAME} f ON f.k = o_custkey % 25
""")
def fill_first_row(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).alias("station_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("region"))
    return fill_region(orders, customer_lookup(spark, sf_dir), order=["row"])


@query("moved_stations", """
SELECT o_custkey AS weather_station_id, arg_max(42 + o_orderkey % 97 / 10.0::DOUBLE, o_orderkey) AS lat,
       arg_max(-80 - o_orderkey % 89 / 10.0::DOUBLE, o_orderkey) AS lon FROM orders GROUP BY 1
""")
def moved_stations(spark, sf_dir):
    key = F.col("o_orderkey")
    places = table(spark, sf_dir, "orders").select(
        "o_custkey", key, (F.lit(42.0) + key % 97 / 10.0).alias("lat"), (F.lit(-80.0) - key % 89 / 10.0).alias("lon"))
    return station_coordinates(places, "lat", "lon", "o_custkey", [-F.col("o_orderkey")])


@query("region_by_long_id", """
SELECT c_custkey, CAST(9007199254740990 + c_custkey AS VARCHAR) AS station_id,
       CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS region FROM customer
""")
def region_by_long_id(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    key = (F.lit(9007199254740990) + F.col("c_custkey")).cast("string")
    nearest = customers.where("c_custkey % 2 = 0").select(
        F.concat(key, F.lit(".0")).alias("point_id"), F.col("c_mktsegment").alias("assigned_region"))
    return attach_region_by_site(customers.select("c_custkey", key.alias("station_id")), nearest)


# Null days.

def dated(spark, sf_dir):
    """Orders of which every fifth has lost its day."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).alias("region"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("date"))


DATED = """dated AS (SELECT o_orderkey, o_custkey % 25 AS region, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders)"""


@query("mean_without_null_days", f"""
WITH {DATED} SELECT region, date, ROUND(CAST(SUM(price) AS DOUBLE) / COUNT(price), 4) AS price
FROM dated WHERE date IS NOT NULL GROUP BY 1, 2
""")
def mean_without_null_days(spark, sf_dir):
    rows = dated(spark, sf_dir).drop("o_orderkey").withColumn("price", F.col("price").cast("double"))
    return rounded(numeric_mean_by(rows, ["region", "date"]), "price", digits=4)


@query("time_split_null_days", f"""
WITH {DATED}, n AS (SELECT o_orderkey, date, ROW_NUMBER() OVER (ORDER BY date, o_orderkey) AS rn,
  floor(COUNT(*) OVER () * 0.5::DOUBLE) AS n_train FROM dated WHERE date IS NOT NULL)
SELECT o_orderkey, date, CASE WHEN rn <= n_train THEN 'train' ELSE 'test' END AS split FROM n
""")
def time_split_null_days(spark, sf_dir):
    return time_split(dated(spark, sf_dir).select("o_orderkey", "date"), "date", "o_orderkey", 0.5)


@query("all_missing_hours", f"""
WITH {WIDE}, g AS (SELECT u.user_id, CAST(d.d AS DATE) AS date FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest(generate_series(DATE '{SPINE_START}', DATE '{SPINE_END}', INTERVAL 1 DAY)) AS d) d)
SELECT g.date, CAST(SUM(({' AND '.join(f'{h} IS NULL' for h in HOURS)})::INT) AS BIGINT) AS n_all_missing
FROM g LEFT JOIN wide ON wide.user_id = g.user_id AND wide.date = g.date GROUP BY 1
""")
def all_missing_hours(spark, sf_dir):
    days = calendar_spine(wide(spark, sf_dir), "user_id", "date", SPINE_START, SPINE_END)
    return all_missing_by_date(days, "date", HOURS)


# Profiles and scaling.

@query("describe", f"""
WITH {DAILY} SELECT COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std,
  ROUND(MIN(value), 6) AS min, ROUND(quantile_cont(value, 0.25), 6) AS p25, ROUND(quantile_cont(value, 0.5), 6) AS p50,
  ROUND(quantile_cont(value, 0.75), 6) AS p75, ROUND(MAX(value), 6) AS max FROM daily
""")
def describe_query(spark, sf_dir):
    return rounded(describe(daily(spark, sf_dir), "value"), "mean", "std", "min", "p25", "p50", "p75", "max", digits=6)


# A row is in as many sequences as can be laid over it.
@query("sequence_scaling", f"""
WITH {DAILY}, l AS (SELECT *, LEAD(value) OVER (PARTITION BY user_id ORDER BY date) AS label FROM daily),
k AS (SELECT user_id, date, value::FLOAT::DOUBLE AS value, n_hours::FLOAT::DOUBLE AS n_hours,
      ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date) AS i, COUNT(*) OVER (PARTITION BY user_id) AS n
      FROM l WHERE label IS NOT NULL),
w AS (SELECT *, least(i, n - i + 1, {SEQ_LEN}, n - {SEQ_LEN} + 1) AS w FROM k WHERE n >= {SEQ_LEN}),
m AS (SELECT SUM(w * value) / SUM(w) AS mv, SUM(w * n_hours) / SUM(w) AS mh FROM w),
s AS (SELECT mv, mh, sqrt(SUM(w * (value - mv) ** 2) / SUM(w)) AS sv, sqrt(SUM(w * (n_hours - mh) ** 2) / SUM(w)) AS sh
      FROM w CROSS JOIN m GROUP BY mv, mh)
SELECT user_id, date AS end_date, ROUND((value - mv) / sv, 5) AS value, ROUND((n_hours - mh) / sh, 5) AS n_hours
FROM w CROSS JOIN s WHERE i >= {SEQ_LEN}
""")
def sequence_scaling(spark, sf_dir):
    made = materialise(user_sequences(spark, sf_dir), "sequences")
    scaled = apply_sequence_scaler(made, fit_sequence_scaler(made))
    last = F.element_at("x", -1)
    return rounded(scaled.select("user_id", "end_date", last[0].alias("value"), last[1].alias("n_hours")), "value", "n_hours", digits=5)


# Files.

@query("tagged_headers", """
SELECT CAST(o_custkey % 5 AS VARCHAR) AS station_id, COUNT(*) AS n_rows, SUM(o_orderkey)::BIGINT AS keys,
       COUNT(CASE WHEN o_custkey % 5 < 3 THEN 1 END) AS n_prices, COUNT(CASE WHEN o_custkey % 5 >= 3 THEN 1 END) AS n_status
FROM orders GROUP BY 1
""")
def tagged_headers(spark, sf_dir):
    path = scratch_path(spark, "headers")
    orders = table(spark, sf_dir, "orders").withColumn("station", F.col("o_custkey") % 5)
    early = orders.where("station < 3").select("o_totalprice", "o_orderkey", "station", F.lit(2001).alias("yr"))
    late = orders.where("station >= 3").select("o_orderkey", "o_orderstatus", "station", F.lit(2002).alias("yr"))
    write_table(early, f"{path}/a", "csv", partition_by=["station", "yr"])
    write_table(late, f"{path}/b", "csv", partition_by=["station", "yr"])
    tagged = read_tagged(spark, f"{path}/*/*/*/*.csv", r"station=([^/]+)/", r"yr=(\d{4})/")
    return tagged.groupBy("station_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"),
        F.count("o_totalprice").alias("n_prices"), F.count("o_orderstatus").alias("n_status"))


@query("station_ids", """
SELECT DISTINCT CAST(CASE page_id % 3 WHEN 0 THEN page_id WHEN 1 THEN page_id * 2 ELSE page_id * 3 END AS VARCHAR) AS station_id FROM pages
""")
def station_ids_query(spark, sf_dir):
    number = F.col("page_id")
    field = F.concat(F.lit("<form><input type='hidden' name=\"StationID\" value=' "), number.cast("string"), F.lit(" '></form>"))
    link = F.concat(F.lit("<a class='x' href=\"/data?y=1&StationID="), (number * 2).cast("string"), F.lit("\">data</a>"))
    bare = F.concat(F.lit("see StationID="), (number * 3).cast("string"), F.lit(" there"))
    made = F.concat("html", F.when(number % 3 == 0, field).when(number % 3 == 1, link).otherwise(bare))
    return station_ids(table(spark, sf_dir, "pages").select("page_id", made.alias("html")))


# Models with a closed form.

@query("signed_metrics", f"""
{PERSISTENCE.rstrip().replace("value AS y_hat", "value - 20 AS y_hat").replace("LEAD(value)", "LEAD(value - 20)")}
SELECT {METRICS.replace("greatest(abs(y), 1e-6)) * 100, 5) AS mape", "greatest(y, 1e-6)) * 100, 0) AS mape")} FROM p
""")
def signed_metrics(spark, sf_dir):
    rows = persistence(spark, sf_dir).select((F.col("y") - 20).alias("y"), (F.col("y_hat") - 20).alias("y_hat"))
    return rounded(rounded_metrics(metrics(rows, "y", "y_hat", signed_mape=True)), "mape_pct", digits=0)


SERIES = """series AS (
  SELECT o_custkey % 25 AS nation_id, CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS value FROM orders GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, LEAD(value) OVER (PARTITION BY nation_id ORDER BY date) AS label FROM series)
      WHERE label IS NOT NULL),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation_id ORDER BY date) - 1 AS i, COUNT(*) OVER (PARTITION BY nation_id) AS size,
      CAST(floor(COUNT(*) OVER (PARTITION BY nation_id) * 0.8::DOUBLE) AS BIGINT) AS n FROM f)"""

# The penalised fit of one feature is its covariance moved towards 0, so the whole search has a closed form.
ONE_FEATURE = f"""WITH {SERIES},
k AS (SELECT *, CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM t WHERE i < n AND size >= 50),
s AS (SELECT nation_id, AVG(value) AS m, STDDEV_POP(value) AS sd, AVG(label) AS ym, COUNT(*) AS n FROM k GROUP BY 1),
z AS (SELECT nation_id, fold, (value - m) / sd AS z, label - ym AS y FROM k JOIN s USING (nation_id)),
a AS (SELECT nation_id, SUM(z * y) AS c, SUM(z * z) AS g, COUNT(*) AS n, abs(SUM(z * y)) / COUNT(*) AS top FROM z GROUP BY 1),
h AS (SELECT nation_id, fold, COUNT(*) AS hn, SUM(z) AS hz, SUM(y) AS hy, SUM(z * z) AS hzz, SUM(z * y) AS hzy, SUM(y * y) AS hyy
      FROM z GROUP BY 1, 2),
r AS (SELECT h.*, top, n - hn AS fn, -hz / (n - hn) AS mz, -hy / (n - hn) AS my, g - hzz AS fzz, c - hzy AS fzy
      FROM h JOIN a USING (nation_id)),
q AS (SELECT *, fzz - fn * mz * mz AS fg, fzy - fn * mz * my AS fc FROM r),
p AS (SELECT *, top * 10 ** (-3.0::DOUBLE * j / 99) AS pen FROM q CROSS JOIN (SELECT unnest(range(100)) AS j)),
b AS (SELECT *, sign(fc) * greatest(abs(fc) - fn * pen, 0) / fg AS b FROM p),
e AS (SELECT nation_id, j, pen, AVG((hyy + hn * (my - mz * b) ** 2 + b * b * hzz - 2 * (my - mz * b) * hy - 2 * b * hzy
      + 2 * (my - mz * b) * b * hz) / hn) AS err FROM b GROUP BY 1, 2, 3),
one AS (SELECT nation_id, arg_min(pen, err) AS pen FROM e GROUP BY 1),
model AS (SELECT nation_id, s.n AS n_train, pen AS penalty, ym AS intercept,
          CASE WHEN abs(c) - a.n * pen > 1e-9 * abs(c) THEN sign(c) * (abs(c) - a.n * pen) / g ELSE 0 END AS coef, m, sd FROM one JOIN a USING (nation_id) JOIN s USING (nation_id))"""


def exact_series(spark, sf_dir):
    """Labelled series of each nation's mean order price, whose sums do not depend on their order."""
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")
    daily_price = table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % 25).alias("nation_id"), F.to_date("o_orderdate").alias("date")).agg(price.alias("value"))
    return next_label(daily_price, "nation_id", "date", "value")


def one_feature(spark, sf_dir):
    models, rows = fit_lasso_by(exact_series(spark, sf_dir), "nation_id", "date", ["value"], "label")
    return materialise(models, "models"), rows


@query("lasso_one_feature", f"""{ONE_FEATURE}
SELECT nation_id, n_train, ROUND(penalty, 2) AS penalty, ROUND(intercept, 2) AS intercept, ROUND(coef, 2) AS coef, TRUE AS converged FROM model
""")
def lasso_one_feature(spark, sf_dir):
    models, _ = one_feature(spark, sf_dir)
    found = models.select("nation_id", "n_train", "penalty", "intercept", F.col("coef")[0].alias("coef"), "converged")
    return rounded(found, "penalty", "intercept", "coef", digits=2)


@query("lasso_one_feature_selected", f"""{ONE_FEATURE}
SELECT nation_id, 'value' AS feature, ROUND(coef, 2) AS coef FROM model WHERE coef <> 0
""")
def lasso_one_feature_selected(spark, sf_dir):
    models, _ = one_feature(spark, sf_dir)
    return rounded(coefficient_table(models, "nation_id", ["value"], selected=True), "coef", digits=2)


@query("lasso_one_feature_metrics", f"""{ONE_FEATURE},
x AS (SELECT nation_id, label AS y, intercept + (value - m) / sd * coef AS y_hat FROM t JOIN model USING (nation_id) WHERE i >= n)
SELECT x.nation_id, COUNT(*) AS n_test, ROUND(AVG(abs(y - y_hat)), 2) AS mae, ROUND(sqrt(AVG((y - y_hat) ** 2)), 2) AS rmse,
       ROUND(penalty, 2) AS alpha, CAST(coef <> 0 AS INTEGER) AS n_selected_features
FROM x JOIN model USING (nation_id) GROUP BY 1, penalty, coef
""")
def lasso_one_feature_metrics(spark, sf_dir):
    models, rows = one_feature(spark, sf_dir)
    found = model_metrics(rows, models, "nation_id", ["value"], "label")
    return rounded(found.select("nation_id", "n_test", "mae", "rmse", "alpha", "n_selected_features"), "mae", "rmse", "alpha", digits=2)


def line_models(rows):
    """Least-squares line of each nation, in the form of a fitted model."""
    fitted = rows.groupBy("nation_id").agg(
        F.regr_intercept("label", "value").alias("intercept"), F.array(F.regr_slope("label", "value")).alias("coef"))
    return fitted.withColumns({"mean": F.array(F.lit(0.0)), "spread": F.array(F.lit(1.0))})


LINES = f"""WITH {SERIES}, model AS (SELECT nation_id, regr_intercept(label, value) AS a, regr_slope(label, value) AS b FROM f GROUP BY 1)"""


@query("linear_scores", f"{LINES} SELECT nation_id, date, ROUND(a + b * value, 4) AS y_hat FROM f JOIN model USING (nation_id)")
def linear_scores(spark, sf_dir):
    rows = exact_series(spark, sf_dir)
    scored = score_linear(rows, line_models(rows), "nation_id", ["value"])
    return rounded(scored.select("nation_id", "date", "y_hat"), "y_hat", digits=4)


@query("linear_coefficients", f"{LINES} SELECT nation_id, 'value' AS feature, ROUND(b, 8) AS coef FROM model")
def linear_coefficients(spark, sf_dir):
    table_ = coefficient_table(line_models(exact_series(spark, sf_dir)), "nation_id", ["value"])
    return rounded(rank_by(table_, "coef", absolute=True, tie=["nation_id"]), "coef")


SEED = 42


@query("linear_permutation", f"""{LINES},
x AS (SELECT nation_id, value, label, a, b, a + b * value AS y_hat,
      ROW_NUMBER() OVER (ORDER BY md5(nation_id || '|' || date || '|{SEED}'), nation_id, date) - 1 AS i, COUNT(*) OVER () AS n
      FROM f JOIN model USING (nation_id)),
d AS (SELECT x.*, o.value AS ov, o.a AS oa, o.b AS ob FROM x
      JOIN x o ON o.i = (x.i + 1 + {exchange_distance(SEED, 2**32) - 1} % (x.n - 1)) % x.n)
SELECT 'value' AS feature, ROUND(AVG(abs(label - y_hat - b * (ov - value))) - AVG(abs(label - y_hat)), 4) AS mae_increase FROM d
UNION ALL SELECT 'nation_id', ROUND(AVG(abs(label - (oa + ob * value))) - AVG(abs(label - y_hat)), 4) FROM d
""")
def linear_permutation(spark, sf_dir):
    rows = materialise(exact_series(spark, sf_dir), "series")
    models = materialise(line_models(rows), "models")
    scored = score_linear(rows, models, "nation_id", ["value"])
    return rounded(permutation_importance(scored, models, "nation_id", "date", ["value"], "label", seed=SEED), "mae_increase", digits=4)


# Every seventh nation's series is replaced by a constant, which cannot be tested.
@query("adf_no_lags", """
WITH series AS (
  SELECT o_custkey % 25 AS nation_id, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_custkey % 25 % 7 = 0 THEN 5.0::DOUBLE ELSE AVG(o_totalprice) END AS value FROM orders GROUP BY 1, 2),
d AS (SELECT nation_id, value - AVG(value) OVER (PARTITION BY nation_id) AS v, date FROM series),
c AS (SELECT nation_id, v - LAG(v) OVER w AS change, LAG(v) OVER w AS level FROM d WINDOW w AS (PARTITION BY nation_id ORDER BY date))
SELECT nation_id, CASE WHEN nation_id % 7 <> 0 THEN ROUND(regr_slope(change, level) / sqrt(
         (regr_syy(change, level) - regr_slope(change, level) * regr_sxy(change, level)) / (COUNT(level) - 2)
         / regr_sxx(change, level)), 5) END AS adf_statistic,
       CASE WHEN nation_id % 7 <> 0 THEN 0 END AS used_lag, COUNT(level) AS n_obs
FROM c GROUP BY 1
""")
def adf_no_lags(spark, sf_dir):
    series = nation_series(spark, sf_dir).withColumn(
        "value", F.when(F.col("nation_id") % 7 == 0, 5.0).otherwise(F.col("value")))
    out = adf_test(series, "nation_id", "date", "value", max_lag=0)
    return rounded(out.drop("p_value"), "adf_statistic", digits=5)


def _without(column: str, *others: str) -> str:
    """SQL for the other columns less their projections on ``column``, per lag order and nation."""
    return ", ".join(
        f"{o} - {column} * COALESCE(SUM({o} * {column}) OVER g / NULLIF(SUM({column} * {column}) OVER g, 0), 0) AS {o}"
        for o in others)


# The lag order by orthogonalising level, first and second past change in turn; the statistic with the level last.
@query("adf_short_lags", f"""
WITH series AS (
  SELECT o_custkey % 25 AS nation_id, CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS value FROM orders GROUP BY 1, 2),
s AS (SELECT nation_id, date, value - LAG(value) OVER w AS c, LAG(value) OVER w AS l FROM series
      WINDOW w AS (PARTITION BY nation_id ORDER BY date)),
p AS (SELECT nation_id, l, c, LAG(c, 1) OVER w AS a, LAG(c, 2) OVER w AS b, ROW_NUMBER() OVER w - 1 AS has
      FROM s WHERE l IS NOT NULL WINDOW w AS (PARTITION BY nation_id ORDER BY date)),
f AS (SELECT k, nation_id, l, c, CASE WHEN k > 0 THEN a ELSE 0 END AS a, CASE WHEN k > 1 THEN b ELSE 0 END AS b
      FROM p JOIN (VALUES (0), (1), (2)) v(k) ON has >= k),
g0 AS (SELECT k, nation_id, l - AVG(l) OVER g AS l, c - AVG(c) OVER g AS c, a - AVG(a) OVER g AS a, b - AVG(b) OVER g AS b
       FROM f WINDOW g AS (PARTITION BY nation_id, k)),
e1 AS (SELECT k, nation_id, {_without("l", "a", "b", "c")} FROM g0 WHERE k = 2 WINDOW g AS (PARTITION BY nation_id, k)),
e2 AS (SELECT k, nation_id, c AS c0, a, {_without("a", "b", "c")} FROM e1 WINDOW g AS (PARTITION BY nation_id, k)),
e3 AS (SELECT nation_id, c0, c AS c1, {_without("b", "c")} FROM e2 WINDOW g AS (PARTITION BY nation_id, k)),
aic AS (SELECT nation_id, COUNT(*) * ln(SUM(c0 * c0)) AS s0, COUNT(*) * ln(SUM(c1 * c1)) + 2 AS s1,
        COUNT(*) * ln(SUM(c * c)) + 4 AS s2 FROM e3 GROUP BY 1),
best AS (SELECT nation_id, CASE WHEN s0 <= s1 AND s0 <= s2 THEN 0 WHEN s1 <= s2 THEN 1 ELSE 2 END AS used_lag FROM aic),
t1 AS (SELECT k, nation_id, {_without("a", "b", "l", "c")} FROM g0 WINDOW g AS (PARTITION BY nation_id, k)),
t2 AS (SELECT k, nation_id, {_without("b", "l", "c")} FROM t1 WINDOW g AS (PARTITION BY nation_id, k)),
t3 AS (SELECT k, nation_id, SUM(c * l) AS cl, SUM(l * l) AS ll, SUM(c * c) AS cc, COUNT(*) AS n FROM t2 GROUP BY 1, 2)
SELECT nation_id, ROUND(cl / ll / sqrt((cc - cl * cl / ll) / (n - 2 - k) / ll), 5) AS adf_statistic, used_lag, n AS n_obs
FROM t3 JOIN best USING (nation_id) WHERE k = used_lag
""")
def adf_short_lags(spark, sf_dir):
    """The choice among no, one and two past changes, whose fits SQL can state in closed form."""
    out = adf_test(nation_series(spark, sf_dir), "nation_id", "date", "value", max_lag=2)
    return rounded(out.drop("p_value"), "adf_statistic", digits=5)
