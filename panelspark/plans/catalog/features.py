"""Feature queries: labels, lags, rolling statistics, imputation, episodes, sequences, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.episodes import event_days, event_episodes
from panelspark.operators.impute import ffill, fill_zero, interpolate_forward
from panelspark.operators.joins import calendar_spine
from panelspark.operators.windows import (
    add_calendar, add_diffs, add_lags, add_rolling, next_label, panel_features, sequence_tail, sequences, time_split,
    time_split_by,
)
from panelspark.plans import stages
from panelspark.plans.catalog.registry import (
    DAILY, DAILY_TYPES, SPINE, SPINE_END, SPINE_START, daily, daily_types, exact_mean, query, rounded, table,
)

BY_USER = "WINDOW w AS (PARTITION BY user_id ORDER BY date)"


@query("next_day_label", f"""
WITH {DAILY} SELECT * FROM (
  SELECT user_id, date, value, n_hours, LEAD(value) OVER w AS label FROM daily {BY_USER}) WHERE label IS NOT NULL
""")
def next_day_label(spark, sf_dir):
    return next_label(daily(spark, sf_dir), "user_id", "date", "value")


@query("lags", f"""
WITH {DAILY} SELECT user_id, date, value, n_hours, {", ".join(f"LAG(value, {k}) OVER w AS value_lag_{k}" for k in (1, 2, 3, 7, 14))},
  LAG(n_hours, 1) OVER w AS n_hours_lag_1, LAG(n_hours, 7) OVER w AS n_hours_lag_7 FROM daily {BY_USER}
""")
def lags(spark, sf_dir):
    return add_lags(daily(spark, sf_dir), "user_id", "date", {"value": [1, 2, 3, 7, 14], "n_hours": [1, 7]})


def _roll_sql(c, n):
    frame = f"OVER (PARTITION BY user_id ORDER BY date ROWS {n - 1} PRECEDING)"
    full = f'COUNT("{c}") {frame} = {n}'
    return (
        f'ROUND(CASE WHEN {full} THEN AVG("{c}") {frame} END, 6) AS {c}_roll_mean_{n}, '
        f'ROUND(CASE WHEN {full} THEN STDDEV_SAMP("{c}") {frame} END, 6) AS {c}_roll_std_{n}'
    )


@query("rolling", f"""
WITH {DAILY_TYPES} SELECT user_id, date, {", ".join(_roll_sql("click", n) for n in (3, 7, 14))}, {_roll_sql("view", 3)}
FROM daily_types
""")
def rolling(spark, sf_dir):
    out = add_rolling(
        daily_types(spark, sf_dir).select("user_id", "date", "click", "view"), "user_id", "date",
        {"click": [3, 7, 14], "view": [3]},
    ).drop("click", "view")
    return rounded(out, *[c for c in out.columns if "_roll_" in c], digits=6)


@query("diffs", f"""
WITH {DAILY} SELECT user_id, date, ROUND(value - LAG(value, 1) OVER w, 6) AS value_diff_1,
  ROUND(value - LAG(value, 7) OVER w, 6) AS value_diff_7 FROM daily {BY_USER}
""")
def diffs(spark, sf_dir):
    out = add_diffs(add_lags(daily(spark, sf_dir), "user_id", "date", {"value": [1, 7]}), "value", [1, 7])
    return rounded(out.select("user_id", "date", "value_diff_1", "value_diff_7"), "value_diff_1", "value_diff_7", digits=6)


def _day_lag_sql(c, k):
    return (f"MAX({c}) OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL {k} DAY PRECEDING "
            f"AND INTERVAL {k} DAY PRECEDING)")


def _day_roll_sql(c, n):
    frame = f"OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL {n - 1} DAY PRECEDING AND CURRENT ROW)"
    full = f"COUNT({c}) {frame} = {n}"
    return (f"ROUND(CASE WHEN {full} THEN AVG({c}) {frame} END, 6) AS {c}_roll_mean_{n}, "
            f"ROUND(CASE WHEN {full} THEN STDDEV_SAMP({c}) {frame} END, 6) AS {c}_roll_std_{n}")


@query("calendar_lags", f"""
WITH {DAILY} SELECT user_id, date, {", ".join(f"{_day_lag_sql('value', k)} AS value_lag_{k}" for k in (1, 2, 3, 7, 14))},
  {_day_lag_sql("n_hours", 1)} AS n_hours_lag_1 FROM daily
""")
def calendar_lags(spark, sf_dir):
    out = add_lags(daily(spark, sf_dir), "user_id", "date", {"value": [1, 2, 3, 7, 14], "n_hours": [1]}, calendar=True)
    return out.drop("value", "n_hours")


@query("calendar_features", f"""
WITH {DAILY} SELECT user_id, date, value, {", ".join(f"{_day_lag_sql('value', k)} AS value_lag_{k}" for k in (1, 7))},
  {_day_roll_sql("value", 3)}, {_day_roll_sql("value", 7)}, ROUND(value - {_day_lag_sql("value", 1)}, 6) AS value_diff_1,
  dayofyear(date)::INT AS day_of_year, ROUND(sin(2 * pi() * dayofyear(date) / 365.0), 6) AS sin_doy,
  ROUND(cos(2 * pi() * dayofyear(date) / 365.0), 6) AS cos_doy FROM daily
""")
def calendar_features(spark, sf_dir):
    out = panel_features(
        daily(spark, sf_dir).select("user_id", "date", "value"), "user_id", "date",
        {"value": [1, 7]}, {"value": [3, 7]}, {"value": [1]}, calendar=True)
    return rounded(out, *[c for c in out.columns if "_roll_" in c or "doy" in c or "diff" in c], digits=6)


@query("calendar_encoding", """
SELECT o_orderkey, dayofyear(o_orderdate)::INT AS day_of_year,
       ROUND(sin(2 * pi() * dayofyear(o_orderdate) / 365.0), 6) AS sin_doy,
       ROUND(cos(2 * pi() * dayofyear(o_orderdate) / 365.0), 6) AS cos_doy FROM orders
""")
def calendar_encoding(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return rounded(add_calendar(rows, "date").drop("date"), "sin_doy", "cos_doy", digits=6)


@query("panel_features", f"""
WITH {DAILY}, f AS (
SELECT user_id, date, value, {", ".join(f"LAG(value, {k}) OVER w AS value_lag_{k}" for k in (1, 2, 3, 7))},
  {", ".join(_roll_sql("value", n) for n in (3, 7))},
  ROUND(value - LAG(value, 1) OVER w, 6) AS value_diff_1,
  dayofyear(date)::INT AS day_of_year, ROUND(sin(2 * pi() * dayofyear(date) / 365.0), 6) AS sin_doy,
  ROUND(cos(2 * pi() * dayofyear(date) / 365.0), 6) AS cos_doy FROM daily {BY_USER})
SELECT * FROM f WHERE value_lag_7 IS NOT NULL
""")
def panel_features_query(spark, sf_dir):
    out = panel_features(
        daily(spark, sf_dir).select("user_id", "date", "value"), "user_id", "date",
        {"value": [1, 2, 3, 7]}, {"value": [3, 7]}, {"value": [1]},
    ).dropna()
    return rounded(out, *[c for c in out.columns if "_roll_" in c or "doy" in c or "diff" in c], digits=6)


AROUND = f"""
WITH {DAILY}, {SPINE}, n AS (SELECT user_id, date, value, ROW_NUMBER() OVER w AS rn FROM spine {BY_USER}),
a AS (SELECT *, LAST_VALUE(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER back AS rn0,
        LAST_VALUE(value IGNORE NULLS) OVER back AS v0,
        FIRST_VALUE(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER ahead AS rn1,
        FIRST_VALUE(value IGNORE NULLS) OVER ahead AS v1
  FROM n WINDOW back AS (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def spine(spark, sf_dir):
    grid = calendar_spine(daily(spark, sf_dir), "user_id", "date", SPINE_START, SPINE_END)
    return grid.select("user_id", "date", "value")


@query("interpolate_forward", AROUND + """
SELECT user_id, date, ROUND(CASE WHEN value IS NOT NULL THEN value WHEN rn - rn0 <= 2 THEN
  CASE WHEN rn1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (rn1 - rn0) * (rn - rn0) END END, 6) AS value FROM a
""")
def interpolate_forward_query(spark, sf_dir):
    return rounded(interpolate_forward(spine(spark, sf_dir), "user_id", "date", {"value": 2}), "value", digits=6)


@query("ffill_limit", AROUND + "SELECT user_id, date, CASE WHEN rn - rn0 <= 2 THEN v0 END AS value FROM a")
def ffill_limit(spark, sf_dir):
    return ffill(spine(spark, sf_dir), "user_id", "date", {"value": 2})


@query("zero_fill", f"WITH {DAILY_TYPES} SELECT user_id, date, COALESCE(click, 0) AS click, COALESCE(view, 0) AS view FROM daily_types")
def zero_fill(spark, sf_dir):
    return fill_zero(daily_types(spark, sf_dir).select("user_id", "date", "click", "view"), ["click", "view", "absent"])


EVENTS = f"""
WITH {DAILY}, e AS (SELECT user_id, date, value, n_hours, value >= 25.0 AND n_hours >= 2 AS event_day FROM daily)
"""


@query("event_days", EVENTS + "SELECT * FROM e")
def event_days_query(spark, sf_dir):
    return event_days(daily(spark, sf_dir), "value", "n_hours", 25.0, 2)


@query("event_episodes", EVENTS + """, s AS (
  SELECT *, CASE WHEN event_day AND NOT COALESCE(LAG(event_day) OVER w AND date - LAG(date) OVER w = 1, FALSE)
            THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY date)),
i AS (SELECT *, CAST(SUM(starts) OVER (PARTITION BY user_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_id FROM s)
SELECT user_id, episode_id, MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_days,
       ROUND(AVG(value), 6) AS mean_value, MAX(value) AS max_value FROM i WHERE event_day GROUP BY 1, 2
""")
def event_episodes_query(spark, sf_dir):
    marked = event_days(daily(spark, sf_dir), "value", "n_hours", 25.0, 2)
    return rounded(event_episodes(marked, "user_id", "date", "value"), "mean_value", digits=6)


# Order prices as series of years, much longer than a block of days. They are divided by a prime, so that no result lies on
# the edge between two rounded values.
YEARS = ("1995-01-01", "2001-12-31")


def prices(spark, sf_dir, entities):
    return table(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") % entities).alias("entity"), F.to_date("o_orderdate").alias("date")
    ).agg((exact_mean("o_totalprice") / 99991).alias("value"))


def prices_sql(entities):
    return f"""prices AS (
  SELECT o_custkey % {entities} AS entity, CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) / 99991 AS value FROM orders GROUP BY 1, 2)"""


LONG_AROUND = f"""
WITH {prices_sql(25)}, n AS (
  SELECT e.entity, CAST(g.d AS DATE) AS date, p.value, row_number() OVER (PARTITION BY e.entity ORDER BY g.d) AS rn
  FROM (SELECT DISTINCT entity FROM prices) e
  CROSS JOIN (SELECT unnest(generate_series(DATE '{YEARS[0]}', DATE '{YEARS[1]}', INTERVAL 1 DAY)) AS d) g
  LEFT JOIN prices p ON p.entity = e.entity AND p.date = CAST(g.d AS DATE)),
a AS (SELECT *, LAST_VALUE(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER back AS rn0,
        LAST_VALUE(value IGNORE NULLS) OVER back AS v0,
        FIRST_VALUE(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER ahead AS rn1,
        FIRST_VALUE(value IGNORE NULLS) OVER ahead AS v1
  FROM n WINDOW back AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def long_spine(spark, sf_dir):
    return calendar_spine(prices(spark, sf_dir, 25), "entity", "date", *YEARS)


@query("interpolate_long_series", LONG_AROUND + """
SELECT entity, date, ROUND(CASE WHEN value IS NOT NULL THEN value WHEN rn - rn0 <= 400 THEN
  CASE WHEN rn1 IS NULL THEN v0 ELSE v0 + (v1 - v0) / (rn1 - rn0) * (rn - rn0) END END, 8) AS value FROM a
""")
def interpolate_long_series(spark, sf_dir):
    return rounded(interpolate_forward(long_spine(spark, sf_dir), "entity", "date", {"value": 400}), "value")


@query("ffill_long_series", LONG_AROUND + "SELECT entity, date, CASE WHEN rn - rn0 <= 400 THEN v0 END AS value FROM a")
def ffill_long_series(spark, sf_dir):
    return ffill(long_spine(spark, sf_dir), "entity", "date", {"value": 400})


@query("long_episodes", f"""
WITH {prices_sql(2)}, e AS (SELECT *, value >= 1 AS event_day FROM prices), s AS (
  SELECT *, CASE WHEN event_day AND NOT COALESCE(LAG(event_day) OVER w AND date - LAG(date) OVER w = 1, FALSE)
            THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY entity ORDER BY date)),
i AS (SELECT *, CAST(SUM(starts) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode_id FROM s)
SELECT entity, episode_id, MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_days,
       ROUND(AVG(value), 8) AS mean_value, MAX(value) AS max_value FROM i WHERE event_day GROUP BY 1, 2
""")
def long_episodes(spark, sf_dir):
    marked = prices(spark, sf_dir, 2).withColumn("event_day", F.col("value") >= 1)
    return rounded(event_episodes(marked, "entity", "date", "value"), "mean_value")


SEQ_LEN = 14


def user_sequences(spark, sf_dir):
    labelled = next_label(daily(spark, sf_dir), "user_id", "date", "value")
    return sequences(labelled, "user_id", "date", ["value", "n_hours"], "label", SEQ_LEN)


SEQUENCES = f"""
WITH {DAILY}, l AS (SELECT *, LEAD(value) OVER w AS label FROM daily {BY_USER}),
k AS (SELECT *, ROW_NUMBER() OVER w AS rn FROM l WHERE label IS NOT NULL {BY_USER})
SELECT b.user_id, b.date AS end_date, (a.rn - b.rn + {{n}})::INT AS step, a.value::FLOAT AS value,
       a.n_hours::FLOAT AS n_hours, b.label::FLOAT AS y
FROM k b JOIN k a ON a.user_id = b.user_id AND a.rn BETWEEN b.rn - {{n}} + 1 AND b.rn WHERE b.rn >= {SEQ_LEN}
"""


def _steps(df):
    return df.select("user_id", "end_date", "y", F.posexplode("x").alias("step", "v")).select(
        "user_id", "end_date", (F.col("step") + 1).alias("step"), F.col("v")[0].alias("value"),
        F.col("v")[1].alias("n_hours"), "y",
    )


@query("sequences", SEQUENCES.format(n=SEQ_LEN))
def sequences_query(spark, sf_dir):
    return _steps(user_sequences(spark, sf_dir))


@query("sequence_tail", SEQUENCES.format(n=7))
def sequence_tail_query(spark, sf_dir):
    return _steps(sequence_tail(user_sequences(spark, sf_dir), 7))


@query("time_split_by_region", f"""
WITH {DAILY} SELECT user_id, date, CASE WHEN ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY date)
  <= floor(COUNT(*) OVER (PARTITION BY user_id) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM daily
""")
def time_split_by_region(spark, sf_dir):
    return time_split_by(daily(spark, sf_dir), "user_id", "date").select("user_id", "date", "split")


@query("time_split_global", f"""
WITH {DAILY}, n AS (SELECT user_id, date, ROW_NUMBER() OVER (ORDER BY date, user_id) AS rn,
  floor(COUNT(*) OVER () * 0.8::DOUBLE) AS n_train FROM daily)
SELECT user_id, date, CASE WHEN rn <= n_train - greatest(floor(0.1::DOUBLE * n_train), 1) THEN 'fit'
  WHEN rn <= n_train THEN 'valid' ELSE 'test' END AS split FROM n
""")
def time_split_global(spark, sf_dir):
    rows = daily(spark, sf_dir).select("user_id", "date")
    return time_split(rows, "date", "user_id", 0.8, valid_frac=0.1)


# A panel with the columns of the study: event types stand in for weather.
WEATHER = {
    "mean_temp_degc": "click", "spd_of_max_gust_km_h": "view", "dir_of_max_gust_deg": "error",
    "total_rain_mm": "purchase", "total_snow_cm": "signup",
}


def study_panel(spark, sf_dir):
    values = daily(spark, sf_dir).select("user_id", "date", F.col("value").alias(stages.PM))
    named = daily_types(spark, sf_dir).withColumnsRenamed({t: c for c, t in WEATHER.items()})
    region = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    return values.join(named, ["user_id", "date"]).select(
        region.alias("region"), "date", stages.PM, *WEATHER, F.lit(0).alias("total_precip_mm"),
        F.lit(1).alias("n_stations_used"), F.lit(0).alias("mean_temp_degc_is_outlier"),
    )


def _fill_sql(c, limit, line):
    between = f"v0_{c} + (v1_{c} - v0_{c}) / (n1_{c} - n0_{c}) * (rn - n0_{c})" if line else f"v0_{c}"
    value = f"CASE WHEN v1_{c} IS NULL THEN v0_{c} ELSE {between} END" if line else between
    return f"ROUND(CASE WHEN {c} IS NOT NULL THEN {c} WHEN rn - n0_{c} <= {limit} THEN {value} END, 6) AS {c}"


def _around_sql(c):
    at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    return (
        f"LAST_VALUE({at} IGNORE NULLS) OVER back AS n0_{c}, LAST_VALUE({c} IGNORE NULLS) OVER back AS v0_{c}, "
        f"FIRST_VALUE({at} IGNORE NULLS) OVER ahead AS n1_{c}, FIRST_VALUE({c} IGNORE NULLS) OVER ahead AS v1_{c}"
    )


GAPPED = ["mean_temp_degc", "spd_of_max_gust_km_h", "dir_of_max_gust_deg"]

IMPUTED = f"""
WITH {DAILY}, {DAILY_TYPES}, p AS (
  SELECT 'User ' || d.user_id AS region, d.date, d.value AS pm25_region_daily_avg,
         {", ".join(f'"{t}" AS {c}' for c, t in WEATHER.items())},
         ROW_NUMBER() OVER (PARTITION BY d.user_id ORDER BY d.date) AS rn
  FROM daily d JOIN daily_types t ON d.user_id = t.user_id AND d.date = t.date WHERE d.user_id <> 3),
a AS (SELECT *, {", ".join(_around_sql(c) for c in GAPPED)} FROM p
  WINDOW back AS (PARTITION BY region ORDER BY rn ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY region ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
imputed AS (SELECT region, date, pm25_region_daily_avg, COALESCE(total_rain_mm, 0) AS total_rain_mm,
       COALESCE(total_snow_cm, 0) AS total_snow_cm, {_fill_sql("mean_temp_degc", 5, True)},
       {_fill_sql("spd_of_max_gust_km_h", 3, True)}, {_fill_sql("dir_of_max_gust_deg", 2, False)} FROM a)
"""


@query("imputed_panel", IMPUTED + "SELECT * FROM imputed")
def imputed_panel(spark, sf_dir):
    return rounded(stages.imputed_panel(study_panel(spark, sf_dir), ["User 3"]), *GAPPED, digits=6)


@query("labelled_panel", IMPUTED + f"""
, g AS (SELECT region, CAST(unnest(generate_series(DATE '{SPINE_START}', DATE '{SPINE_END}', INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT region FROM imputed))
SELECT * FROM (
  SELECT g.region, g.date, i.* EXCLUDE (region, date), LEAD(pm25_region_daily_avg) OVER (PARTITION BY g.region ORDER BY g.date) AS pm25_label
  FROM g LEFT JOIN imputed i ON g.region = i.region AND g.date = i.date) WHERE pm25_label IS NOT NULL
""")
def labelled_panel(spark, sf_dir):
    panel = stages.imputed_panel(study_panel(spark, sf_dir), ["User 3"])
    return rounded(stages.labelled_panel(panel, SPINE_START, SPINE_END), *GAPPED, digits=6)
