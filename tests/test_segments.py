import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators.episodes import event_episodes
from panelspark.operators.impute import ffill, interpolate_forward
from panelspark.operators.segments import in_blocks
from panelspark.operators.windows import add_lags, add_rolling, panel_features

BLOCKS = [1, 2, 5, 256]


def gapped(seed, days=70, entities=4):
    """Rows with missing days and missing readings, as (entity, day number, value)."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([(e, d) for e in range(entities) for d in range(days) if rng.random() < 0.8], columns=["e", "n"])
    pdf["v"] = np.where(rng.random(len(pdf)) < 0.35, rng.integers(0, 50, len(pdf)).astype(float), np.nan)
    pdf.loc[pdf["e"] == 1, "v"] = np.nan  # a series without a reading
    return pdf


def as_spark(spark, pdf, *more):
    data = [(int(r.e), day(int(r.n)), None if np.isnan(r.v) else float(r.v), *(bool(getattr(r, m)) for m in more)) for r in pdf.itertuples()]
    return spark.createDataFrame(data, "e long, d date, v double" + "".join(f", {m} boolean" for m in more))


@pytest.mark.parametrize("block_days", BLOCKS)
@pytest.mark.parametrize("limit", [1, 6, 1000])
def test_gaps_across_blocks(spark, block_days, limit):
    pdf = gapped(limit)
    df, by = as_spark(spark, pdf), pdf.groupby("e")["v"]
    want = by.transform(lambda s: s.interpolate(method="linear", limit=limit, limit_direction="forward"))
    got = [r["v"] for r in interpolate_forward(df, "e", "d", {"v": limit}, block_days).orderBy("e", "d").collect()]
    np.testing.assert_allclose(np.array(got, float), want)
    got = [r["v"] for r in ffill(df, "e", "d", {"v": limit}, block_days).orderBy("e", "d").collect()]
    np.testing.assert_allclose(np.array(got, float), by.ffill(limit=limit))


def brute_episodes(pdf):
    out = []
    for e, part in pdf.sort_values("n").groupby("e"):
        number, last = 0, None
        for r in part.itertuples():
            if r.event:
                if last is None or last.n != r.n - 1 or not last.event:
                    number += 1
                    out.append([e, number, r.n, r.n, []])
                out[-1][3] = r.n
                out[-1][4].append(r.v)
            last = r
    found = []
    for e, number, a, b, values in out:
        real = [v for v in values if not np.isnan(v)]
        found.append((e, number, day(int(a)), day(int(b)), len(values), round(sum(real) / len(real), 9) if real else None, max(real, default=None)))
    return sorted(found, key=str)


@pytest.mark.parametrize("block_days", BLOCKS)
@pytest.mark.parametrize("share", [0.3, 0.9, 1.0])
def test_episodes_across_blocks(spark, block_days, share):
    pdf = gapped(3)
    pdf["event"] = np.random.default_rng(4).random(len(pdf)) < share
    got = event_episodes(as_spark(spark, pdf, "event"), "e", "d", "v", "event", block_days)
    got = got.withColumn("mean_value", F.round("mean_value", 9))
    assert sorted(rows(got), key=str) == brute_episodes(pdf)


def test_one_entity_of_a_million_days(spark):
    """The work of one entity is spread over its blocks, and no row is ordered within the whole entity."""
    n = 1_000_000
    df = spark.range(n).select(
        F.lit("hot").alias("e"), F.date_add(F.lit("0200-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
        F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"), (F.col("id") % 5000 < 4000).alias("event"))
    filled = interpolate_forward(df, "e", "d", {"v": n})
    plan = filled._jdf.queryExecution().executedPlan().toString()
    by_row = re.findall(r"windowspecdefinition\((.*?) ASC|windowspecdefinition\((.*?) DESC", plan)
    assert by_row and all("_block" in a + b for a, b in by_row)
    spec = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)
    assert all("_block" in keys or order.startswith("_block") for keys, order in spec)
    last = n - n % 1000 - 1000 if n % 1000 == 0 else n - n % 1000
    wrong = filled.withColumn("i", F.datediff("d", F.lit("0200-01-01").cast("date"))).where(
        F.abs(F.col("v") - F.least("i", F.lit(last))) > 1e-6)
    assert wrong.count() == 0 and filled.where("v is null").count() == 0
    blocks = in_blocks(df, "e", "d").groupBy("_block").count().agg(F.max("count"), F.count("*")).first()
    assert blocks[0] <= 256 and blocks[1] >= n / 256
    found = event_episodes(df, "e", "d", "v", "event")
    assert found.count() == n / 5000 and found.agg(F.min("n_days"), F.max("n_days"), F.max("episode_id")).first() == (4000, 4000, n / 5000)


def test_repeated_day_fails(spark):
    df = spark.createDataFrame([(1, day(0), 1.0), (1, day(0), 2.0)], "e long, d date, v double")
    with pytest.raises(Exception, match="duplicate entity and day"):
        ffill(df, "e", "d", {"v": 1}).collect()


def test_days_and_rows_differ_where_a_day_is_missing(spark):
    df = spark.createDataFrame([(1, day(0), 1.0), (1, day(1), 2.0), (1, day(3), 4.0), (1, day(4), None), (1, day(5), 6.0), (2, day(4), 9.0)],
                               "e long, d date, v double")
    by_day = add_lags(df, "e", "d", {"v": [1, 2]}, calendar=True).select("e", "d", "v_lag_1", "v_lag_2")
    assert rows(by_day, "e", "d") == [
        (1, day(0), None, None), (1, day(1), 1.0, None), (1, day(3), None, 2.0), (1, day(4), 4.0, None), (1, day(5), None, 4.0),
        (2, day(4), None, None)]
    by_row = add_lags(df, "e", "d", {"v": [1]}).where("e = 1").select("d", "v_lag_1")
    assert rows(by_row, "d") == [(day(0), None), (day(1), 1.0), (day(3), 2.0), (day(4), 4.0), (day(5), None)]
    means = add_rolling(df, "e", "d", {"v": [2]}, calendar=True).where("e = 1").select("d", "v_roll_mean_2")
    assert rows(means, "d") == [(day(0), None), (day(1), 1.5), (day(3), None), (day(4), None), (day(5), None)]
    assert [r[0] for r in rows(add_rolling(df, "e", "d", {"v": [2]}).where("e = 1").orderBy("d").select("v_roll_mean_2"))] == [
        None, 1.5, 3.0, None, None]
    plan = panel_features(df, "e", "d", {"v": [1]}, {"v": [2]}, {"v": [1]}, calendar=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
