"""Source and sink queries. Files are written from the tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.aggregates import HOURS
from panelspark.plans.catalog.geo import supplier_sites
from panelspark.plans.catalog.panel import MIN_HOURS, WIDE, wide
from panelspark.plans.catalog.registry import query, regions, rounded, table
from panelspark.plans.catalog.features import SEQ_LEN, SEQUENCES, _steps, user_sequences
from panelspark.plans.catalog.sites import HAVERSINE_SQL
from panelspark.plans.stages import hourly_table, region_day_pm, region_day_weather
from panelspark.operators.clean import coerce_numeric
from panelspark.session import scratch_path
from panelspark.sources.files import first_existing, load_coverage, read_id_list, read_tagged
from panelspark.sources.pages import extract_ids, page_links
from panelspark.sources.reports import extract_station_meta, read_block_report, report_preambles
from panelspark.sources.sinks import read_sequences, write_sequences, write_table


def write_reports(spark, sf_dir) -> str:
    """One block report per user with a preamble, written as the text files of one year."""
    cells = [F.coalesce(F.col(h).cast("string"), F.lit("9999")) for h in HOURS]
    station = (F.col("user_id") + 1000).cast("string")
    line = F.concat_ws(",", station, F.lit("PM"), F.col("date").cast("string"), *cells, F.lit(","))
    days = wide(spark, sf_dir).select("user_id", F.struct("date", line.alias("line")).alias("day"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Station, User "), F.col("user_id").cast("string"), F.lit(" ("), station, F.lit(")")),
        F.concat(F.lit("Latitude, "), (F.col("user_id") % 10 + 42.5).cast("string")),
        F.concat(F.lit("Longitude, -"), (F.col("user_id") % 7 + 79.25).cast("string")),
        F.lit(""),
        F.concat_ws(",", F.lit("Station ID,Pollutant,Date"), *[F.lit(h) for h in HOURS]),
        F.array_join(F.transform(F.array_sort(F.collect_list("day")), lambda d: d["line"]), "\n"),
    )
    path = f"{scratch_path(spark, 'reports')}/ON_PM25_2024-01-01_2024-12-31"
    days.groupBy("user_id").agg(block.alias("value")).select("value").write.text(path)
    return path


@query("block_report_rows", f"""
WITH {WIDE} SELECT user_id + 1000 AS "Station ID", 'PM' AS "Pollutant", date AS "Date", {", ".join(f"ROUND({h}, 8) AS {h}" for h in HOURS)},
2024 AS year FROM wide
""")
def block_report_rows(spark, sf_dir):
    return rounded(read_block_report(spark, write_reports(spark, sf_dir)), *HOURS)


@query("station_meta", """
SELECT DISTINCT user_id + 1000 AS station_id, 'User ' || user_id AS station_name, user_id % 10 + 42.5::DOUBLE AS latitude,
       -(user_id % 7 + 79.25::DOUBLE) AS longitude FROM events
""")
def station_meta(spark, sf_dir):
    meta = extract_station_meta(report_preambles(spark, write_reports(spark, sf_dir)))
    return meta.select("station_id", "station_name", "latitude", "longitude")


@query("reports_to_region_day", f"""
WITH {WIDE}, long AS (UNPIVOT wide ON {", ".join(HOURS)} INTO NAME h VALUE v),
station AS (SELECT user_id, date, CASE WHEN COUNT(*) >= {MIN_HOURS} THEN AVG(v) END AS m FROM long GROUP BY 1, 2)
SELECT s.date AS "Date", n.n_name AS region, ROUND(AVG(m), 8) AS pm25_region_daily_avg,
       COUNT(DISTINCT user_id) AS n_stations_total, COUNT(m) AS n_stations_used
FROM station s LEFT JOIN nation n ON s.user_id % 25 = n.n_nationkey GROUP BY 1, 2
""")
def reports_to_region_day(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    nations = regions(spark, sf_dir)
    lookup = users.join(nations, users["user_id"] % 25 == nations["nation_id"], "left").select(
        (F.col("user_id") + 1000).alias("station_id"), "region"
    )
    hourly = hourly_table(spark, write_reports(spark, sf_dir))
    return rounded(region_day_pm(hourly, lookup, MIN_HOURS, lookup_order=["station_id"]), "pm25_region_daily_avg")


@query("weather_to_region_day", f"""
WITH raw AS (
  SELECT o_orderkey, o_custkey AS station, CAST(o_orderdate AS DATE) AS date, o_totalprice / 9000 AS temp,
         CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_orderkey % 40 END::DOUBLE AS rain, o_orderstatus = 'P' AS trace,
         42 + (o_custkey * 37 % 1000) / 100.0::DOUBLE AS lat, -95 + (o_custkey * 53 % 2000) / 100.0::DOUBLE AS lon
  FROM orders),
one AS (SELECT * FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY station, date ORDER BY o_orderkey) = 1),
sites AS (SELECT s_suppkey AS ord, n_name AS region, 42 + (s_suppkey * 41 % 1000) / 100.0::DOUBLE AS lat,
  -95 + (s_suppkey * 59 % 2000) / 100.0::DOUBLE AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
near AS (
  SELECT p.station, s.region, ROUND({HAVERSINE_SQL}, 9) AS km FROM (SELECT DISTINCT station, lat, lon FROM raw) p
  CROSS JOIN sites s QUALIFY ROW_NUMBER() OVER (PARTITION BY p.station ORDER BY km, s.ord) = 1)
SELECT n.region, o.date, ROUND(AVG(CASE WHEN temp <= 50 THEN temp END), 8) AS max_temp_degc,
       ROUND(AVG((temp > 50)::INT), 8) AS max_temp_degc_is_outlier, ROUND(AVG(rain), 8) AS total_rain_mm,
       ROUND(AVG(trace::INT), 8) AS total_rain_mm_is_trace
FROM one o JOIN near n ON o.station = n.station WHERE n.km <= 75 GROUP BY 1, 2
""")
def weather_to_region_day(spark, sf_dir):
    key = F.col("o_custkey")
    raw = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("station_id"), F.col("o_orderdate").cast("string").alias("Date/Time"),
        (F.col("o_totalprice") / 9000).alias("Max Temp (°C)"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 40).cast("string").alias("Total Rain (mm)"),
        F.when(F.col("o_orderstatus") == "P", "T").alias("Total Rain Flag"),
        F.col("o_orderkey").alias("Source Row"), (F.lit(42.0) + key * 37 % 1000 / 100.0).alias("Latitude (y)"),
        (F.lit(-95.0) + key * 53 % 2000 / 100.0).alias("Longitude (x)"),
    )
    cols = ["max_temp_degc", "max_temp_degc_is_outlier", "total_rain_mm", "total_rain_mm_is_trace"]
    panel = region_day_weather(raw, supplier_sites(spark, sf_dir), order=["source_row"])
    return rounded(panel.select("region", "date", *cols), *cols)


@query("tagged_files", """
SELECT CAST(o_custkey % 5 AS VARCHAR) AS station_id, year(o_orderdate)::INT AS year, COUNT(*) AS n_rows,
       SUM(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2
""")
def tagged_files(spark, sf_dir):
    path = scratch_path(spark, "tagged")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_custkey") % 5).alias("station"), F.year("o_orderdate").alias("yr")
    )
    write_table(orders, path, "csv", partition_by=["station", "yr"])
    tagged = read_tagged(spark, f"{path}/*/*/*.csv", r"station=([^/]+)/", r"yr=(\d{4})/")
    numbers = coerce_numeric(tagged, ["o_orderkey"])
    return numbers.groupBy("station_id", "year").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").cast("long").alias("keys")
    )


@query("load_coverage", """
WITH f AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders),
g AS (SELECT c_custkey, y.year FROM customer CROSS JOIN (SELECT unnest(generate_series(1995, 2001)) AS year) y)
SELECT g.year::INT AS year, COUNT(f.o_custkey) AS n_loaded, COUNT(*) - COUNT(f.o_custkey) AS n_missing
FROM g LEFT JOIN f ON f.o_custkey = g.c_custkey AND f.year = g.year GROUP BY 1
""")
def load_coverage_query(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_id"), F.year("o_orderdate").alias("year"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"))
    return load_coverage(files, ids, list(range(1995, 2002)))


@query("id_list", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS station_id FROM events")
def id_list(spark, sf_dir):
    path = scratch_path(spark, "ids")
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    lines = F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" \n\n"))
    ids.select(lines.alias("value")).write.text(path)
    return read_id_list(spark, path)


@query("ids_from_pages", r"""
WITH found AS (
  SELECT unnest(regexp_extract_all(url, '[?&]page=(\d+)', 1)) AS station_id FROM pages
  UNION ALL SELECT unnest(regexp_extract_all(url, '/(\d+)', 1)) FROM pages
  UNION ALL SELECT unnest(regexp_extract_all(html, 'track\((\w+)\)', 1)) FROM pages)
SELECT DISTINCT station_id FROM found WHERE regexp_full_match(station_id, '\d+')
""")
def ids_from_pages(spark, sf_dir):
    patterns = {"url": [r"[?&]page=(\d+)", r"/(\d+)"], "html": [r"track\((\w+)\)"]}
    return extract_ids(table(spark, sf_dir, "pages"), patterns, inputs=["html"])


@query("page_links", r"""
SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages
""")
def page_links_query(spark, sf_dir):
    return page_links(table(spark, sf_dir, "pages"))


@query("roundtrip_csv", "SELECT o_orderkey::DOUBLE AS o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority FROM orders")
def roundtrip_csv(spark, sf_dir):
    path = scratch_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"), "o_orderpriority")
    write_table(orders, path, "csv", codec="gzip")
    return coerce_numeric(first_existing(spark, [f"{path}-panel", path]), ["o_orderkey"])


@query("roundtrip_sequences", SEQUENCES.format(n=SEQ_LEN))
def roundtrip_sequences(spark, sf_dir):
    path = scratch_path(spark, "sequences")
    write_sequences(user_sequences(spark, sf_dir), path, ["value", "n_hours"])
    stored, names = read_sequences(spark, path)
    if names != ["value", "n_hours"]:
        raise ValueError(f"unexpected feature names {names}")
    return _steps(stored)
