"""Registry of example queries: each runs an operator over whole tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    """Round columns, so that sums taken in another order compare equal."""
    return df.withColumns({c: F.expr(f"round(`{c}`, {digits}) + 0D") for c in cols})


def cents(value: str) -> Column:
    """A value with two decimals as an exact decimal."""
    return F.col(value).cast("decimal(18,2)")


def exact_mean(value: str, condition: Column | None = None) -> Column:
    """Mean that does not depend on the order of summation."""
    exact = cents(value) if condition is None else F.when(condition, cents(value))
    return F.try_divide(F.sum(exact).cast("double"), F.count(exact).cast("double"))


# Stand-ins for the panel: a user is a station, its events are readings, the nation of the user is its region.

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "user_id", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "event_type", "value"
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: exact mean, and number of distinct hours with a reading."""
    return readings(spark, sf_dir).groupBy("user_id", "date").agg(
        exact_mean("value").alias("value"),
        F.expr("cast(bit_count(bit_or(shiftleft(1, hour))) as bigint)").alias("n_hours"),
    )


def daily_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: exact mean of each event type, null where there is none."""
    return readings(spark, sf_dir).groupBy("user_id", "date").agg(
        *[exact_mean("value", F.col("event_type") == t).alias(t) for t in EVENT_TYPES]
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup of region names by nation key."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nation_id"), F.col("n_name").alias("region")
    )


DAILY = """daily AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS value,
         COUNT(DISTINCT hour(ts)) AS n_hours
  FROM events GROUP BY 1, 2)"""

DAILY_TYPES = "daily_types AS (SELECT user_id, CAST(ts AS DATE) AS date, " + ", ".join(
    f"CAST(SUM(CAST(value AS DECIMAL(18,2))) FILTER (event_type = '{t}') AS DOUBLE)"
    f" / NULLIF(COUNT(*) FILTER (event_type = '{t}'), 0) AS \"{t}\""
    for t in EVENT_TYPES
) + " FROM events GROUP BY 1, 2)"

SPINE_START, SPINE_END = "2023-12-30", "2024-02-02"

SPINE = f"""spine AS (
  SELECT u.user_id, CAST(g.d AS DATE) AS date, d.value, d.n_hours
  FROM (SELECT DISTINCT user_id FROM events) u
  CROSS JOIN (SELECT unnest(generate_series(DATE '{SPINE_START}', DATE '{SPINE_END}', INTERVAL 1 DAY)) AS d) g
  LEFT JOIN daily d ON d.user_id = u.user_id AND d.date = CAST(g.d AS DATE))"""
