import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators.ordering import before_rank, day_counts, exact_quantiles, ordered_index
from panel_helpers import day


def test_ordered_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("x")).repartition(5)
    got = ordered_index(df, F.desc("x"), "k").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000))
    assert [(-r["x"], r["k"]) for r in got] == sorted((-r["x"], r["k"]) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_with_a_hot_value(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.where(rng.random(2001) < 0.4, 7.0, rng.normal(7, 3, 2001).round(2))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 0.999, 1.0]
    np.testing.assert_allclose(exact_quantiles(df, "v", probs), np.quantile(values, probs), atol=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("rank", [0, 1, 2, 3, 4, 5, 9])
def test_before_rank(spark, rank):
    data = [(day(1), "a"), (day(1), "b"), (day(0), "z"), (day(2), "c"), (day(2), "d")]
    df = spark.createDataFrame(data, "d date, e string")
    got = df.where(before_rank(df, "d", "e", day_counts(df, "d"), rank)).collect()
    assert sorted(tuple(r) for r in got) == sorted(data)[:rank]
