import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import quantiles
from panelspark.operators.profile import distribution_summary_by

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def data():
    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=6000).tolist(), "ties": [float(v) for v in rng.integers(0, 3, 900)], "one": [7.0],
              "two": [1.0, 2.0], None: rng.exponential(size=40).tolist(), "copies": [5.0] * 800}
    return groups, [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("two", None)]


@pytest.mark.parametrize("accuracy", [10, 200, 10_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, accuracy):
    groups, rows = data()
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r["k"]: r for r in quantiles.grouped_quantiles(df, ["k"], "x", PROBS, accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, name)


def test_a_range_that_misses_its_rank_becomes_whole(spark):
    values = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, v double").select(F.struct("k").alias("g"), "v")
    spot = "struct<i:int,rank:double,first:bigint,last:bigint,low:double,high:double>"
    wrong = spark.createDataFrame([(("a",), [(0, 49.5, 49, 50, 60.0, 70.0), (1, 49.5, 49, 50, 40.0, 60.0)])], f"g struct<k:string>, spots array<{spot}>")
    first, second = quantiles._checked(values, wrong, 2).first()["spots"]
    assert (first["low"], first["below"]) == (float("-inf"), 0) and np.isnan(first["high"])
    assert (second["low"], second["high"], second["below"]) == (40.0, 60.0, 40)


def test_summary_by_group(spark):
    groups, rows = data()
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in distribution_summary_by(df, ["k"], "x").collect()}
    assert got["none"]["n"] == 0 and got["none"]["p50"] is None
    assert got[None]["p90"] == pytest.approx(np.quantile(groups[None], 0.9)) and got["hot"]["n"] == 6000
    assert distribution_summary_by(df.where("false"), ["k"], "x").count() == 0
