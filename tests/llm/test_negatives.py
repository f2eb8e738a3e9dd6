import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<double>, label int, row string, id string, vector string, score string, dim string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)


def brute(rows, every=10):
    usable = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(256 * x)) for x in v], label))
    last = 2**63

    def ranked(a, fits):
        scored = [(sum(x * y for x, y in zip(a[1], b[1])), b[0]) for b in usable
                  if len(b[1]) == len(a[1]) and (b[0] is None or b[0] != a[0]) and fits(b)]
        return sorted(scored, key=lambda s: (-s[0], last if s[1] is None else s[1]))

    out = []
    for a in usable:
        if a[0] is not None and a[0] % every == 0:
            for p, pid in ranked(a, lambda b: b[2] == a[2])[:5]:
                window = [s for s in ranked(a, lambda b: b[2] != a[2]) if 80 * p <= 100 * s[0] <= 100 * p]
                out += [(a[0], pid, r + 1, nid, p, n) for r, (n, nid) in enumerate(window[:5])]
    return sorted(map(str, out))


def run(df, every=10):
    return sorted(str(tuple(r)) for r in neg.hard_negatives(df, F.col("vec_id") % every == 0).collect())


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels, several trees a shard, several shards and blocks of anchors on few rows."""
    for name, value in dict(BLOCK_ROWS=60, SHARD_ROWS=150, BLOCK_ANCHORS=20, LEAF_ROWS=8, FANOUT=3, SAMPLE_ROWS=40).items():
        monkeypatch.setattr(neg, name, value)


def test_clusters_ties_and_copies(spark, small):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 7))
    rows = [(i, (centres[i % 6] + rng.normal(size=7) * 0.2).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(i, rows[3][1], i % 2) for i in range(400, 480)]  # one vector, many rows
    rows += [rows[10], rows[10]] + [(i, [0.0] * 7, 1) for i in range(480, 490)]
    assert run(table(spark, rows)) == brute(rows)


def test_rows_that_take_no_part(spark, small):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist(), i % 2) for i in range(60)]
    rows += [(100, None, 1), (110, [1.0, None, 2.0], 1), (120, [1.0, float("nan"), 2.0], 0), (130, [1.0, 2.0, float("inf")], 0),
             (140, [1.0, 2.0, 3.0], None), (150, [], 1), (151, [], 0), (160, [1.0, 1.0], 0), (161, [1.0, 1.0], 1), (162, [1.0, 1.0], 0),
             (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 0), (170, [1e300, 0.0, 0.0], 1)]
    assert run(table(spark, rows)) == brute(rows[:-1])
    assert run(table(spark, [])) == [] == run(table(spark, rows[60:65])) == run(table(spark, rows[:1]))


def test_labels_of_one_kind_and_hot_label(spark, small):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist(), 0 if i % 3 else i) for i in range(150)]
    assert run(table(spark, rows)) == brute(rows)
    assert run(table(spark, [(i, v, 1) for i, v, _ in rows])) == []


def test_far_nodes_are_not_read(monkeypatch):
    """Clusters far from the anchor are skipped whole; the rows found are those of a full scan."""
    monkeypatch.setattr(neg, "LEAF_ROWS", 64)  # less than a cluster
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 400
    points = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 4)
    norm2 = float((points**2).sum(axis=1).max())
    tree = neg.build(points, np.arange(4000), np.zeros(4000, np.int64), norm2)
    anchors = points[::500]
    low, high = np.full((8, 1), neg.NOTHING + 1), np.full((8, 1), neg.NO_ID)
    search = neg.Search(anchors, np.arange(0, 4000, 500), np.ones(8, np.int64), low, high, False, norm2, 5)
    read, verify = [], search.verify
    search.verify = lambda who, t, a, b: (read.append(len(who) * (b - a)), verify(who, t, a, b))
    search.run([tree])
    assert sum(read) < 8 * 4000 / 4
    scores = (anchors @ points.T).astype(int)
    for i in range(8):
        order = [j for j in sorted(range(4000), key=lambda j: (-scores[i, j], j)) if j != i * 500][:5]
        assert search.found[i, 0].tolist() == order
