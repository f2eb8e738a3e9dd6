"""Nearest-site queries: customers are points, suppliers are sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.scalars import composite_label, haversine_km
from panelspark.operators.geo import assigned_counts, assigned_totals, farthest, nearest_site, station_coordinates
from panelspark.operators.profile import distribution_summary
from panelspark.plans.catalog.registry import query, rounded, table
from panelspark.plans.catalog.sites import NEAREST_SQL


def _place(key: str, lat_step: int, lon_step: int):
    return [
        (F.lit(42.0) + F.col(key) * lat_step % 1000 / 100.0).alias("lat"),
        (F.lit(-95.0) + F.col(key) * lon_step % 2000 / 100.0).alias("lon"),
    ]


def customer_points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), *_place("c_custkey", 37, 53))


def supplier_sites(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    return suppliers.select(
        F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("site_id"), "region", *_place("s_suppkey", 41, 59)
    )


def nearest_suppliers(spark, sf_dir):
    return nearest_site(customer_points(spark, sf_dir), supplier_sites(spark, sf_dir), 75.0)


@query("nearest_site", f"WITH {NEAREST_SQL} SELECT * FROM nearest")
def nearest_site_query(spark, sf_dir):
    return rounded(nearest_suppliers(spark, sf_dir), "distance_km", digits=6)


@query("nearest_site_totals", f"""
WITH {NEAREST_SQL} SELECT COUNT(*) AS n_points, COUNT(*) FILTER (within_threshold) AS n_assigned,
COUNT(*) FILTER (NOT within_threshold) AS n_unassigned FROM nearest
""")
def nearest_site_totals(spark, sf_dir):
    return assigned_totals(nearest_suppliers(spark, sf_dir))


@query("assigned_regions_top_10", f"""
WITH {NEAREST_SQL} SELECT assigned_region, COUNT(*) AS n_points FROM nearest WHERE within_threshold
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def assigned_regions_top_10(spark, sf_dir):
    return assigned_counts(nearest_suppliers(spark, sf_dir))


@query("farthest_10", f"""
WITH {NEAREST_SQL} SELECT point_id, assigned_region, distance_km, within_threshold FROM nearest
ORDER BY distance_km DESC, point_id LIMIT 10
""")
def farthest_10(spark, sf_dir):
    return farthest(rounded(nearest_suppliers(spark, sf_dir), "distance_km", digits=6))


@query("nearest_site_summary", f"""
WITH {NEAREST_SQL}
SELECT COUNT(*) AS n, ROUND(AVG(distance_km), 6) AS mean, ROUND(STDDEV_SAMP(distance_km), 6) AS std,
       MIN(distance_km) AS min, ROUND(quantile_cont(distance_km, 0.5), 6) AS p50,
       ROUND(quantile_cont(distance_km, 0.9), 6) AS p90, ROUND(quantile_cont(distance_km, 0.95), 6) AS p95,
       ROUND(quantile_cont(distance_km, 0.99), 6) AS p99, MAX(distance_km) AS max FROM nearest
""")
def nearest_site_summary(spark, sf_dir):
    nearest = rounded(nearest_suppliers(spark, sf_dir), "distance_km", digits=6)
    return rounded(distribution_summary(nearest, "distance_km"), "mean", "std", "p50", "p90", "p95", "p99", digits=6)


@query("haversine", """
SELECT c_custkey, ROUND(2 * 6371.0 * asin(sqrt(least(1.0,
  pow(sin((radians(45.0) - radians(42 + (c_custkey * 37 % 1000) / 100.0::DOUBLE)) / 2), 2)
  + cos(radians(45.0)) * cos(radians(42 + (c_custkey * 37 % 1000) / 100.0::DOUBLE))
  * pow(sin((radians(-80.0) - radians(-95 + (c_custkey * 53 % 2000) / 100.0::DOUBLE)) / 2), 2)))), 6) AS km
FROM customer
""")
def haversine(spark, sf_dir):
    points = customer_points(spark, sf_dir)
    km = haversine_km("lat", "lon", F.lit(45.0), F.lit(-80.0))
    return rounded(points.select(F.col("point_id").alias("c_custkey"), km.alias("km")), "km", digits=6)


@query("composite_label", """
SELECT c.c_custkey, COALESCE(n.n_name, 'Unknown') || ' (' || c.c_custkey || ')' AS label
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey
""")
def composite_label_query(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    customers = table(spark, sf_dir, "customer")
    joined = customers.join(nation, customers["c_nationkey"] == nation["n_nationkey"], "left")
    return joined.select("c_custkey", composite_label("n_name", "c_custkey").alias("label"))


@query("synthetic_id", """
WITH p AS (SELECT DISTINCT 42 + (c_custkey * 37 % 1000) / 100.0::DOUBLE AS lat,
                           -95 + (c_custkey * 53 % 2000) / 100.0::DOUBLE AS lon FROM customer)
SELECT 'lat' || ROUND(lat, 5) || '_lon' || ROUND(lon, 5) AS weather_station_id, lat, lon FROM p
""")
def synthetic_id_query(spark, sf_dir):
    return station_coordinates(customer_points(spark, sf_dir), "lat", "lon", None, [])
