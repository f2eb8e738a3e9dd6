import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panel_helpers import day, rows
from panelspark.operators import dedupe
from panelspark.session import materialise

SCHEMA = "k long, d date, name string, a double, b double, pos int"


def test_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, None)], "a int, b int")
    assert rows(dedupe.duplicate_count(df)) == [(4, 2)]
    assert dedupe.drop_full_duplicates(df).count() == 2


ODD = [
    (1, None, "x", 0.0), (None, 1, "x", 0.0), (1, None, "x", -0.0), (1, None, None, 0.0), (None, None, None, None),
    (None, None, None, None), (2, 3, "", float("nan")), (2, 3, "", float("nan")), (2, 3, None, float("nan")), (4, 4, "q", 1.0),
]


@pytest.mark.parametrize("bits", [128, 70, 64, 5, 1, 0])
def test_duplicates_by_fingerprint(spark, bits):
    df = spark.createDataFrame(ODD * 2 + [(i % 40, i, str(i % 3), None) for i in range(60)], "_word0 int, `a.b` int, Marks string, v double")
    df = df.repartition(5).cache()
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    plain = dedupe.drop_full_duplicates(df).select(F.array(*text).alias("r")).collect()
    found = dedupe.drop_full_duplicates(df, fingerprints=True, bits=bits)
    assert found.columns == df.columns
    key = lambda r: [(c is None, "0.0" if c == "-0.0" else c or "") for c in r.r]
    assert sorted(map(key, found.select(F.array(*text).alias("r")).collect())) == sorted(map(key, plain))
    assert rows(dedupe.duplicate_count(df, fingerprints=True, bits=bits)) == rows(dedupe.duplicate_count(df)) == [(80, 13)]


def test_duplicates_by_fingerprint_in_empty_tables(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert dedupe.drop_full_duplicates(df, fingerprints=True).count() == 0
    assert rows(dedupe.duplicate_count(df, fingerprints=True)) == [(0, 0)]


def _shuffled(df):
    """Bytes of all exchanges of rows, from the metrics of the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("dataSize").value()
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return total


def test_wide_rows_stay_in_place(spark):
    wide = F.concat_ws("", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(20)])
    df = spark.range(4000, numPartitions=4).select((F.col("id") % 3960).alias("id")).select("id", wide.alias("text"))
    df = materialise(df, "wide")
    plain, narrow = _shuffled(dedupe.drop_full_duplicates(df)), _shuffled(dedupe.drop_full_duplicates(df, fingerprints=True))
    counts = _shuffled(dedupe._fingerprint_counts(df, 128))
    assert plain > 10 * (narrow + counts) > 0


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, "late", 9), (1, "early", 2), (2, None, 5), (None, "x", 1)], "k int, v string, pos int")
    assert rows(dedupe.first_per_key(df, ["k"], ["pos"]), "k") == [(None, "x", 1), (1, "early", 2), (2, None, 5)]


CASES = [
    (1, day(0), "s", 1.0, None, 1),  # exact duplicate
    (1, day(0), "s", 1.0, None, 2),
    (2, day(0), None, 1.0, None, 3),  # complementary
    (2, day(0), "t", None, 5.0, 4),
    (3, day(0), None, 1.0, 2.0, 5),  # conflict: distinct values 1 and 3
    (3, day(0), "u", 1.0, None, 6),
    (3, day(0), "v", 3.0, None, 7),
    (4, day(0), "w", 1.0, 1.0, 8),  # three-way conflict
    (4, day(0), "w", 2.0, 1.0, 9),
    (4, day(0), "w", 6.0, 1.0, 10),
    (5, None, "x", 2.0, None, 11),  # null in the key
    (5, None, "x", 4.0, None, 12),
    (6, day(1), "y", None, None, 13),  # alone and empty
]
MERGED = [
    (1, day(0), "s", 1.0, None, 1), (2, day(0), None, 1.0, 5.0, 3), (3, day(0), "u", 2.0, 2.0, 5),
    (4, day(0), "w", 3.0, 1.0, 8), (5, None, "x", 3.0, None, 11), (6, day(1), "y", None, None, 13),
]


def test_merge_key_duplicates(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    assert rows(dedupe.merge_key_duplicates(df, ["k", "d"], ["a", "b"], ["pos"]), "k") == MERGED


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_does_not_depend_on_row_order(spark, seed):
    shuffled = random.Random(seed).sample(CASES, len(CASES))
    df = spark.createDataFrame(shuffled, SCHEMA).repartition(seed * 3)
    assert rows(dedupe.merge_key_duplicates(df, ["k", "d"], ["a", "b"], ["pos"]), "k") == MERGED


def test_merge_against_pandas_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "k": np.where(rng.random(900) < 0.4, 0, rng.integers(1, 300, 900)),
        "a": rng.integers(0, 40, 900).astype(float), "b": rng.integers(0, 3, 900).astype(float), "pos": range(900),
    })
    pdf.loc[rng.random(900) < 0.2, "a"] = None
    want = pdf.groupby("k")[["a", "b"]].agg(lambda s: np.mean(s.dropna().unique()) if s.notna().any() else None)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, a double, b double, pos long")
    got = dedupe.merge_key_duplicates(df, ["k"], ["a", "b"], ["pos"]).toPandas().set_index("k").sort_index()
    np.testing.assert_allclose(got["a"].astype(float), want["a"].astype(float), rtol=1e-12)
    np.testing.assert_allclose(got["b"].astype(float), want["b"].astype(float), rtol=1e-12)


def test_conflicts(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    found = dedupe.key_conflicts(df, ["k", "d"], ["a", "b"])
    assert rows(found.select("k", "n_rows", "is_conflict"), "k") == [
        (1, 2, False), (2, 2, False), (3, 3, True), (4, 3, True), (5, 2, True),
    ]
    assert rows(dedupe.conflict_totals(found)) == [(5, 3, 2)]
    conflict, other = dedupe.split_by_conflict(df.where("d is not null"), ["k", "d"], ["a", "b"])
    assert sorted(r["pos"] for r in conflict.collect()) == [5, 6, 7, 8, 9, 10]
    assert sorted(r["pos"] for r in other.collect()) == [1, 2, 3, 4]


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    assert dedupe.assert_unique(df, ["k", "v"]).count() == 2
    with pytest.raises(ValueError):
        dedupe.assert_unique(df, ["k"])
