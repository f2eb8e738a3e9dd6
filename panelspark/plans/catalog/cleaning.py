"""Cleaning, naming and de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.names import (
    date_column, drop_matching, hour_columns, normalise_headers, numeric_columns, pick_col, rename_roles, reorder,
    snake_case, station_column,
)
from panelspark.functions.scalars import (
    clamp, date_parts, day_diff, direction_degrees, has_mark, inverse_target, log1p_target, to_day, to_month, to_number,
)
from panelspark.operators.clean import (
    drop_all_zero, drop_near_constant, exclude, flag_indicators, null_sentinels, prune_panel, range_check, zero_trace,
)
from panelspark.operators.dedupe import (
    conflict_totals, drop_full_duplicates, duplicate_count, first_per_key, key_conflicts, merge_key_duplicates,
    split_by_conflict,
)
from panelspark.plans.catalog.registry import query, rounded, table


@query("coerce_and_sentinel", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity NOT IN (7, 13) THEN l_quantity END AS l_quantity,
       TRY_CAST(CASE WHEN l_linenumber = 3 THEN '<31' WHEN l_linenumber = 5 THEN 'NaN'
                     ELSE CAST(l_partkey AS VARCHAR) END AS BIGINT)::DOUBLE AS reading
FROM lineitem
""")
def coerce_and_sentinel(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 3, "<31").when(F.col("l_linenumber") == 5, "NaN").otherwise(
        F.col("l_partkey").cast("string")
    )
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", to_number(text).alias("reading")
    )
    return null_sentinels(rows, ["l_quantity"], [7, 13])


@query("props_number", """
SELECT event_id, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events
""")
def props_number(spark, sf_dir):
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1)
    return table(spark, sf_dir, "events").select("event_id", to_number(k).alias("k"))


@query("flag_indicators", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'T' WHEN l_returnflag = 'A' THEN 'E' END AS letter,
       CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity END AS total_rain_mm,
       (l_returnflag = 'R')::INT AS total_rain_mm_is_trace, (l_returnflag = 'A')::INT AS total_rain_mm_is_estimated,
       0 AS total_rain_mm_is_missingflag, 0 AS total_rain_mm_is_lowquality,
       (l_returnflag IN ('R', 'A'))::INT AS data_quality_has_mark
FROM lineitem
""")
def flag_indicators_query(spark, sf_dir):
    letter = F.when(F.col("l_returnflag") == "R", "T").when(F.col("l_returnflag") == "A", "E")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", letter.alias("letter"), F.col("l_quantity").alias("total_rain_mm")
    )
    out = zero_trace(flag_indicators(rows, "total_rain_mm", "letter"), ["total_rain_mm"])
    out = out.withColumn("data_quality_has_mark", has_mark("letter"))
    return out.select([F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(c) for c, t in out.dtypes])


@query("range_check", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS l_quantity,
       (l_quantity NOT BETWEEN 5 AND 45)::INT AS l_quantity_is_outlier,
       (l_linenumber * 100) % 360 + 0.0::DOUBLE AS direction
FROM lineitem
""")
def range_check_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", direction_degrees(F.col("l_linenumber") * 10).alias("direction")
    )
    checked = range_check(rows, {"l_quantity": (5, 45)})
    return checked.withColumn("l_quantity_is_outlier", F.col("l_quantity_is_outlier").cast("int"))


@query("drop_constant_columns", "SELECT event_id, user_id, value, CASE WHEN value > 5 THEN 0 END AS with_null FROM events")
def drop_constant_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value", F.lit(0).alias("zeros"), F.lit(4.5).alias("same"),
        F.when(F.col("value") > 5, 0).alias("with_null"),
    )
    pruned = drop_all_zero(rows)
    kept = drop_near_constant(pruned.drop("with_null"))
    return pruned.select(*kept.columns, "with_null")


@query("snake_case_columns", """
SELECT event_id AS station_id, value AS max_temp_degc, user_id AS spd_of_max_gust_km_h, event_type AS year
FROM events
""")
def snake_case_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias(" Station ID"), F.col("ts").alias("Year"), F.col("value").alias("Max Temp (°C)"),
        F.col("user_id").alias("Spd of Max Gust (km/h)"), F.col("event_type").alias("year "),
    )
    return snake_case(raw)


@query("role_columns", """
SELECT user_id AS station_id, CAST(ts AS DATE) AS date, event_type AS note, value AS "H01", value * 2 AS "H02" FROM events
""")
def role_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        (F.col("value") * 2).alias("H02"), F.col("event_type").alias(" NOTE "), F.col("value").alias("H01"),
        F.to_date("ts").alias("DATE_LOCAL"), F.col("user_id").alias("Station ID"),
    )
    roles = {date_column(raw): "date", station_column(raw): "station_id", pick_col(raw, ["note"]) or "": "note"}
    named = rename_roles(normalise_headers(raw, lower=False), {k.strip(): v for k, v in roles.items()})
    return reorder(named, ["station_id", "date"], hour_columns(named))


@query("pruned_panel", """
SELECT c.c_custkey, n.n_name AS region, c.c_acctbal FROM customer c
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey
WHERE n.n_name IS NULL OR n.n_name <> 'NATION_1'
""")
def pruned_panel(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    customers = table(spark, sf_dir, "customer")
    panel = customers.join(nation, customers["c_nationkey"] == nation["n_nationkey"], "left").select(
        "c_custkey", F.col("n_name").alias("region"), "c_acctbal", F.lit(0).alias("total_snow_cm"),
        F.lit(1).alias("c_acctbal_is_trace"), F.lit(3.0).alias("level"), F.lit("x").alias("data_quality"),
        F.lit(2).alias("n_stations_total"),
    )
    return prune_panel(panel, ["NATION_1"])


@query("excluded_segments", """
SELECT c_mktsegment, COUNT(*) AS n, ROUND(AVG(c_acctbal), 6) AS c_acctbal FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1
""")
def excluded_segments(spark, sf_dir):
    kept = exclude(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"])
    kept = drop_matching(kept, suffix="_name")
    cols = numeric_columns(kept, exclude=["c_custkey"], exclude_containing="nation")
    return kept.groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), *[(F.round(F.avg(c), 6)).alias(c) for c in cols]
    )


@query("parse_dates", """
WITH t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'not a day' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text
  FROM orders)
SELECT o_orderkey, d AS date, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day,
       dayofyear(d)::INT AS day_of_year, date_trunc('month', d)::DATE AS month_start,
       date_diff('day', DATE '1995-01-01', d)::INT AS days
FROM (SELECT o_orderkey, TRY_CAST(text AS DATE) AS d FROM t)
""")
def parse_dates(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 10 == 3, "not a day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    days = table(spark, sf_dir, "orders").select("o_orderkey", to_day(text).alias("date"))
    return days.withColumns(
        {**date_parts("date"), "month_start": to_month("date"), "days": day_diff("date", F.lit("1995-01-01").cast("date"))}
    )


@query("string_math_functions", """
SELECT c_custkey, lower(trim('  ' || c_mktsegment || ' ')) AS segment, regexp_replace(c_name, '[^0-9]+', '', 'g') AS digits,
       ((CAST(floor(c_acctbal) AS BIGINT) % 360) + 360) % 360 AS turn, ROUND(abs(c_acctbal), 1) AS size,
       least(greatest(c_acctbal, 0.0), 5000.0)::DOUBLE AS clamped, ROUND(sqrt(abs(c_acctbal)), 6) AS root,
       ROUND(ln(1 + greatest(c_acctbal, 0.0)), 6) AS logged, ROUND(greatest(c_acctbal, 0.0), 4) AS restored
FROM customer
""")
def string_math_functions(spark, sf_dir):
    balance = F.col("c_acctbal")
    out = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment"),
        F.regexp_replace("c_name", "[^0-9]+", "").alias("digits"),
        F.pmod(F.floor(balance), F.lit(360).cast("long")).alias("turn"), F.round(F.abs(balance), 1).alias("size"),
        clamp(balance, 0.0, 5000.0).alias("clamped"), F.sqrt(F.abs(balance)).alias("root"),
        log1p_target(balance).alias("logged"), inverse_target(log1p_target(balance)).alias("restored"),
    )
    return rounded(rounded(out, "root", "logged", digits=6), "restored", digits=4)


@query("drop_full_duplicates", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def drop_full_duplicates_query(spark, sf_dir):
    rows = drop_full_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))
    return rows.select(F.md5("text").alias("text_md5"), "lang")


@query("duplicate_count", """
SELECT COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_extra
FROM documents
""")
def duplicate_count_query(spark, sf_dir):
    return duplicate_count(table(spark, sf_dir, "documents").select("text", "lang"))


@query("drop_wide_duplicates", "SELECT md5(text) AS text_md5, source, lang, n_chars FROM (SELECT DISTINCT text, source, lang, n_chars FROM documents)")
def drop_wide_duplicates_query(spark, sf_dir):
    """Every column of documents but their number."""
    rows = drop_full_duplicates(table(spark, sf_dir, "documents").drop("doc_id"), fingerprints=True)
    return rows.select(F.md5("text").alias("text_md5"), "source", "lang", "n_chars")


@query("wide_duplicate_count", """
SELECT COUNT(*) AS n_rows, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, source, lang, n_chars FROM documents)) AS n_extra
FROM documents
""")
def wide_duplicate_count_query(spark, sf_dir):
    return duplicate_count(table(spark, sf_dir, "documents").drop("doc_id"), fingerprints=True)


@query("first_per_key", """
SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY ROW_NUMBER() OVER (
  PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_quantity) = 1
""")
def first_per_key_query(spark, sf_dir):
    return first_per_key(supplier_days(spark, sf_dir), ["l_suppkey", "date"], ["l_orderkey", "l_linenumber", "l_quantity"])


def supplier_days(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_quantity"
    )


@query("merge_key_duplicates", """
WITH r AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber,
         CASE WHEN l_quantity <> 9 THEN l_quantity END AS q, CASE WHEN l_discount <> 0.05 THEN l_discount * 100 END AS d
  FROM lineitem),
b AS (
  SELECT l_suppkey, date, l_orderkey, l_linenumber FROM r
  QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey, date ORDER BY
    (q IS NOT NULL)::INT + (d IS NOT NULL)::INT DESC, l_orderkey, l_linenumber) = 1),
m AS (
  SELECT l_suppkey, date, ROUND(AVG(DISTINCT q), 6) AS l_quantity, ROUND(AVG(DISTINCT ROUND(d)), 6) AS l_discount
  FROM r GROUP BY 1, 2)
SELECT * FROM m JOIN b USING (l_suppkey, date)
""")
def merge_key_duplicates_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_discount") != 0.05, F.round(F.col("l_discount") * 100)).alias("l_discount"),
    )
    clean = null_sentinels(rows, ["l_quantity"], [9])
    merged = merge_key_duplicates(clean, ["l_suppkey", "date"], ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"])
    return rounded(merged, "l_quantity", "l_discount", digits=6)


CONFLICTS = """conflicts AS (
  SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n_rows, COUNT(DISTINCT l_quantity) > 1 AS is_conflict
  FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1)"""


@query("key_conflicts", f"WITH {CONFLICTS} SELECT * FROM conflicts")
def key_conflicts_query(spark, sf_dir):
    return key_conflicts(supplier_days(spark, sf_dir), ["l_suppkey", "date"], ["l_quantity"])


@query("conflict_totals", f"""
WITH {CONFLICTS} SELECT COUNT(*) AS n_duplicate_keys, COUNT(*) FILTER (is_conflict) AS n_conflict_keys,
COUNT(*) FILTER (NOT is_conflict) AS n_other_keys FROM conflicts
""")
def conflict_totals_query(spark, sf_dir):
    return conflict_totals(key_conflicts_query(spark, sf_dir))


@query("conflict_rows", f"""
WITH {CONFLICTS}
SELECT l.l_suppkey, CAST(l.l_shipdate AS DATE) AS date, l.l_orderkey, l.l_linenumber, l.l_quantity, c.is_conflict
FROM lineitem l JOIN conflicts c ON l.l_suppkey = c.l_suppkey AND CAST(l.l_shipdate AS DATE) = c.date
""")
def conflict_rows(spark, sf_dir):
    conflict, other = split_by_conflict(supplier_days(spark, sf_dir), ["l_suppkey", "date"], ["l_quantity"])
    return conflict.withColumn("is_conflict", F.lit(True)).unionByName(other.withColumn("is_conflict", F.lit(False)))
