"""Readings to panel: completeness rule, region means, joins, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.names import require_columns
from panelspark.functions.scalars import normalise_id
from panelspark.operators.aggregates import (
    HOURS, entity_weighted_monthly, hour_profile, hourly_wide, mean_by_entity, mean_series, numeric_mean_by,
    region_day, seasonality, sort_panel, station_day, station_day_from_readings, tail_by_date, top_entities,
)
from panelspark.operators.dedupe import assert_unique
from panelspark.operators.joins import (
    attach_region_by_site, attach_station_meta, attach_station_region, calendar_spine, distinct_keys, fill_region,
    join_panels, union_all, union_ids, unmapped_keys,
)
from panelspark.operators.ordering import ordered_index
from panelspark.operators.profile import audit_table, observe_step
from panelspark.plans.catalog.geo import nearest_suppliers
from panelspark.plans.catalog.registry import (
    DAILY, DAILY_TYPES, EVENT_TYPES, SPINE, SPINE_END, SPINE_START, daily, daily_types, exact_mean, query,
    readings, regions, rounded, table,
)
from panelspark.plans.catalog.sites import NEAREST_SQL
from panelspark.session import materialise

MIN_HOURS = 2


@query("region_day_mean", f"""
WITH hourly AS (
  SELECT user_id, CAST(ts AS DATE) AS date, hour(ts) AS hour, AVG(value) AS mean FROM events GROUP BY 1, 2, 3),
station AS (
  SELECT user_id, date, CASE WHEN COUNT(*) >= {MIN_HOURS} THEN AVG(mean) END AS daily_mean
  FROM hourly GROUP BY 1, 2)
SELECT s.date, n.n_name AS region, ROUND(AVG(s.daily_mean), 8) AS region_daily_mean,
       COUNT(DISTINCT s.user_id) AS n_stations_total, COUNT(s.daily_mean) AS n_stations_used
FROM station s LEFT JOIN nation n ON s.user_id % 25 = n.n_nationkey GROUP BY 1, 2
""")
def region_day_mean(spark, sf_dir):
    station = station_day_from_readings(
        readings(spark, sf_dir), ["user_id", "date"], F.col("hour"), "value", min_hours=MIN_HOURS
    )
    mapped = fill_region(station.withColumn("nation_id", F.col("user_id") % 25), regions(spark, sf_dir), "nation_id", order=["nation_id"])
    return rounded(region_day(mapped, "date", "region", "user_id", "daily_mean"), "region_daily_mean")


def wide(spark, sf_dir):
    return hourly_wide(readings(spark, sf_dir), ["user_id", "date"], F.col("hour") + 1, "value")


WIDE = "wide AS (SELECT user_id, CAST(ts AS DATE) AS date, " + ", ".join(
    f"AVG(value) FILTER (hour(ts) + 1 = {i}) AS {name}" for i, name in enumerate(HOURS, 1)
) + " FROM events GROUP BY 1, 2)"


@query("hourly_wide", f"WITH {WIDE} SELECT user_id, date, "
       + ", ".join(f"ROUND({h}, 8) AS {h}" for h in HOURS) + " FROM wide")
def hourly_wide_query(spark, sf_dir):
    return rounded(wide(spark, sf_dir), *HOURS)


@query("station_day_wide", f"""
WITH {WIDE}, long AS (UNPIVOT wide ON {", ".join(HOURS)} INTO NAME h VALUE v),
means AS (SELECT user_id, date, COUNT(*) AS n, AVG(v) AS m FROM long GROUP BY 1, 2)
SELECT user_id, date, CAST(n AS INTEGER) AS n_hours,
       CASE WHEN n >= {MIN_HOURS} THEN ROUND(m, 8) END AS daily_mean FROM means
""")
def station_day_wide(spark, sf_dir):
    return rounded(station_day(wide(spark, sf_dir), MIN_HOURS), "daily_mean")


@query("hour_profile", f"""
WITH {WIDE}, long AS (UNPIVOT wide ON {", ".join(HOURS)} INTO NAME h VALUE v)
SELECT CAST(substr(h, 2) AS INTEGER) AS hour, ROUND(AVG(v), 8) AS mean FROM long GROUP BY 1
""")
def hour_profile_query(spark, sf_dir):
    return rounded(hour_profile(wide(spark, sf_dir)), "mean")


@query("station_meta_join", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def station_meta_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return attach_station_meta(orders, customers, "o_custkey").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


def partial_lookup(spark, sf_dir):
    """Nation names for the nations of the first three regions, padded with blanks."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return nation.select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("region"))


@query("lookup_region", """
SELECT c.c_custkey, c.c_nationkey, n.n_name AS region
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey
""")
def lookup_region(spark, sf_dir):
    lookup = partial_lookup(spark, sf_dir).withColumnRenamed("n_nationkey", "c_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return attach_station_region(customers, lookup, "c_nationkey", order=["c_nationkey"]).select("c_custkey", "c_nationkey", "region")


@query("lookup_fill", """
SELECT c.c_custkey, c.c_nationkey,
       COALESCE(CASE WHEN c.c_acctbal < 0 THEN 'OWN' END, n.n_name) AS region
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey
""")
def lookup_fill(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") < 0, "OWN").alias("region")
    )
    lookup = partial_lookup(spark, sf_dir).withColumnRenamed("n_nationkey", "c_nationkey")
    return fill_region(customers, lookup, "c_nationkey", order=["c_nationkey"])


@query("unmapped_keys", """
SELECT c_nationkey, COUNT(*) AS n_rows, MIN(c_name) AS c_name FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1
""")
def unmapped_keys_query(spark, sf_dir):
    lookup = partial_lookup(spark, sf_dir).withColumnRenamed("n_nationkey", "c_nationkey")
    return unmapped_keys(table(spark, sf_dir, "customer"), lookup, "c_nationkey", carry=["c_name"])


@query("weather_region_attach", f"""
WITH {NEAREST_SQL}
SELECT CAST(o.o_custkey AS VARCHAR) AS station_id, o.o_orderkey, b.assigned_region AS region
FROM orders o LEFT JOIN nearest b ON b.point_id = o.o_custkey
""")
def weather_region_attach(spark, sf_dir):
    weather = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("double").cast("string").alias("station_id"), "o_orderkey"
    )
    nearest = nearest_suppliers(spark, sf_dir).withColumn("point_id", F.col("point_id").cast("double").cast("string"))
    return attach_region_by_site(weather, nearest)


def order_days(spark, sf_dir):
    """Orders per nation of the customer and day of the month, moved into the month of the events."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).alias("nation_id"),
        F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("o_orderdate")).alias("date"),
        "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("is_final"),
    )


def nation_days(spark, sf_dir):
    """Mean of the daily user means per nation and day."""
    return (
        daily(spark, sf_dir).groupBy((F.col("user_id") % 25).alias("nation_id"), "date")
        .agg(F.avg("value").alias("value"), F.count("*").alias("n_users"))
    )


_PANELS = f"""
WITH {DAILY}, pm AS (
  SELECT user_id % 25 AS nation_id, date, AVG(value) AS value, COUNT(*) AS n_users FROM daily GROUP BY 1, 2),
wx AS (
  SELECT o_custkey % 25 AS nation_id, make_date(2024, 1, day(o_orderdate)) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS price, COUNT(*) AS n_orders
  FROM orders WHERE o_custkey % 25 <> 7 GROUP BY 1, 2)
SELECT p.nation_id, p.date, ROUND(p.value, 8) AS value, p.n_users, ROUND(w.price, 6) AS price, w.n_orders
FROM pm p {{how}} JOIN wx w ON p.nation_id = w.nation_id AND p.date = w.date
"""


def _panels(spark, sf_dir, how):
    weather = order_days(spark, sf_dir).where("nation_id <> 7").groupBy("nation_id", "date").agg(
        exact_mean("o_totalprice").alias("price"), F.count("*").alias("n_orders")
    )
    return rounded(rounded(join_panels(nation_days(spark, sf_dir), weather, ["nation_id", "date"], how), "value"), "price", digits=6)


@query("panel_inner_join", _PANELS.format(how="INNER"))
def panel_inner_join(spark, sf_dir):
    return _panels(spark, sf_dir, "inner")


@query("panel_left_join", _PANELS.format(how="LEFT"))
def panel_left_join(spark, sf_dir):
    return _panels(spark, sf_dir, "left")


@query("weather_region_mean", """
SELECT l_suppkey % 25 AS nation_id, date_trunc('month', l_shipdate)::DATE AS month,
       ROUND(AVG(l_quantity), 8) AS l_quantity, ROUND(AVG(l_discount), 8) AS l_discount,
       ROUND(AVG(l_tax), 8) AS l_tax, ROUND(AVG(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 8) AS is_returned
FROM lineitem GROUP BY 1, 2
""")
def weather_region_mean(spark, sf_dir):
    means = numeric_mean_by(_shipments(spark, sf_dir), ["nation_id", "month"])
    return rounded(means, "l_quantity", "l_discount", "l_tax", "is_returned")


def _shipments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("nation_id"), F.trunc("l_shipdate", "MM").alias("month"),
        "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("byte").alias("is_returned"),
        F.col("l_suppkey").alias("station_id"), "l_linestatus",
    )


@query("chosen_measures_mean", """
SELECT l_suppkey % 25 AS nation_id, date_trunc('month', l_shipdate)::DATE AS month,
       ROUND(AVG(l_quantity), 8) AS l_quantity, ROUND(AVG(l_tax), 8) AS l_tax FROM lineitem GROUP BY 1, 2
""")
def chosen_measures_mean(spark, sf_dir):
    means = numeric_mean_by(_shipments(spark, sf_dir), ["nation_id", "month"], ["l_quantity", "l_tax"])
    return rounded(means, "l_quantity", "l_tax")


@query("calendar_spine", f"WITH {DAILY}, {SPINE} SELECT user_id, date, value, n_hours FROM spine")
def calendar_spine_query(spark, sf_dir):
    return calendar_spine(daily(spark, sf_dir), "user_id", "date", SPINE_START, SPINE_END)


@query("daily_series", f"WITH {DAILY} SELECT date, ROUND(AVG(value), 8) AS mean FROM daily GROUP BY 1")
def daily_series(spark, sf_dir):
    return rounded(mean_series(daily(spark, sf_dir), "date", "value"), "mean")


@query("entity_weighted_month", """
WITH m AS (
  SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS v FROM orders GROUP BY 1, 2)
SELECT month, ROUND(AVG(v), 6) AS entity_weighted_mean FROM m GROUP BY 1
""")
def entity_weighted_month(spark, sf_dir):
    out = entity_weighted_monthly(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(out, "entity_weighted_mean", digits=6)


@query("seasonality", """
WITH m AS (SELECT o_custkey, month(o_orderdate) AS month_num, AVG(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT CAST(month_num AS INTEGER) AS month_num, ROUND(AVG(v), 6) AS entity_weighted_mean FROM m GROUP BY 1
""")
def seasonality_query(spark, sf_dir):
    out = seasonality(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return rounded(out, "entity_weighted_mean", digits=6)


@query("mean_by_entity", f"WITH {DAILY} SELECT user_id, ROUND(AVG(value), 8) AS mean, COUNT(value) AS n_days FROM daily GROUP BY 1")
def mean_by_entity_query(spark, sf_dir):
    return rounded(mean_by_entity(daily(spark, sf_dir), ["user_id"], "value"), "mean")


@query("top_entities", f"""
WITH {DAILY} SELECT user_id, ROUND(AVG(value), 8) AS mean, COUNT(value) AS n_days
FROM daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30
""")
def top_entities_query(spark, sf_dir):
    ranked = rounded(mean_by_entity(daily(spark, sf_dir), ["user_id"], "value"), "mean")
    return top_entities(ranked, "mean", 30, tie="user_id")


@query("last_30", f"""
SELECT CAST(o_orderdate AS DATE) AS date, ROUND(AVG(o_totalprice), 6) AS mean
FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30
""")
def last_30(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return rounded(tail_by_date(mean_series(orders, "date", "o_totalprice"), "date", 30), "mean", digits=6)


@query("union_years", """
SELECT year(o_orderdate) AS year, o_orderkey,
       CASE WHEN year(o_orderdate) < 1998 THEN o_orderstatus END AS o_orderstatus,
       CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority
FROM orders
""")
def union_years(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    early = orders.where("o_orderdate < date'1998-01-01'").select("year", "o_orderkey", "o_orderstatus")
    late = orders.where("o_orderdate >= date'1998-01-01'").select("o_orderkey", "year", "o_orderpriority")
    return union_all(early, late)


@query("union_ids", """
SELECT user_id AS station_id FROM events UNION SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders
""")
def union_ids_query(spark, sf_dir):
    return union_ids(
        distinct_keys(table(spark, sf_dir, "events"), ["user_id"]).withColumnRenamed("user_id", "station_id"),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id")),
        distinct_keys(table(spark, sf_dir, "orders"), ["o_custkey"]).withColumnRenamed("o_custkey", "station_id"),
    )


@query("validated_panel", f"WITH {DAILY} SELECT user_id, date, value FROM daily")
def validated_panel(spark, sf_dir):
    panel = require_columns(daily(spark, sf_dir), ["user_id", "date", "value"])
    return assert_unique(panel, ["user_id", "date"]).select("user_id", "date", "value")


@query("audit_counts", f"""
WITH {DAILY}, {DAILY_TYPES}, {SPINE}
SELECT 'daily' AS step, COUNT(*) AS n_rows, 7 AS n_columns,
       CAST(SUM({" + ".join(f'("{t}" IS NULL)::INT' for t in EVENT_TYPES)}) AS BIGINT) AS n_nulls FROM daily_types
UNION ALL
SELECT 'spine', COUNT(*), 7, CAST(SUM({" + ".join(f'(t."{t}" IS NULL)::INT' for t in EVENT_TYPES)}) AS BIGINT)
FROM spine s LEFT JOIN daily_types t ON s.user_id = t.user_id AND s.date = t.date
""")
def audit_counts(spark, sf_dir):
    first, seen_first = observe_step(daily_types(spark, sf_dir), "daily")
    second, seen_second = observe_step(
        calendar_spine(materialise(first, "audit"), "user_id", "date", SPINE_START, SPINE_END), "spine"
    )
    materialise(second, "audit")
    return audit_table(second, [("daily", len(first.columns), seen_first), ("spine", len(second.columns), seen_second)])


@query("sorted_panel", f"""
WITH {DAILY} SELECT user_id, date, value, ROW_NUMBER() OVER (ORDER BY user_id, date) - 1 AS position FROM daily
""")
def sorted_panel(spark, sf_dir):
    panel = daily(spark, sf_dir).select("user_id", "date", "value")
    return sort_panel(ordered_index(panel, "user_id", "date"), "user_id", "date")


@query("normalised_ids", """
SELECT user_id, COUNT(*) AS n_rows FROM events GROUP BY 1
""")
def normalised_ids(spark, sf_dir):
    spelled = F.concat(F.lit(" "), F.col("user_id").cast("double").cast("string"), F.lit(" "))
    ids = table(spark, sf_dir, "events").select(normalise_id(spelled).cast("long").alias("user_id"))
    return ids.groupBy("user_id").agg(F.count("*").alias("n_rows"))
