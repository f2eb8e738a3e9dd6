import random
from itertools import combinations

import numpy as np
import pytest

from llm_helpers import changed, documents, odd_rows, prose
from panelspark.llm import parity
from panelspark.llm.parity import apart_at_least, bands, folded, jaccard_components, long_sketch, part_keys, possible, without
from panelspark.llm.textkit import mix64


def shingle_set(text, words):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\x1c", "?").split(" ")
    w = [x for x in " ".join(w).replace("\n", " ").replace("\t", " ").split(" ") if x]
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)])


def brute(rows, words=5, percent=80):
    sets = [shingle_set(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(find(i), []).append(r[0])
    return sorted(str((r[0], len(sets[i]), min(groups.get(find(i), [None])) if sets[i] else r[0])) for i, r in enumerate(rows))


def run(df, **given):
    return sorted(str(tuple(r)) for r in jaccard_components(df, **given).collect())


@pytest.mark.parametrize("percent", [80, 75, 50, 93])
def test_similar_sets_share_a_key(percent):
    """Sets at the very threshold, of all sizes and with every split of the difference."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 257, 1000, 4000]:
        for _ in range(6):
            whole = mix64(rng.choice(2**62, 3 * n, replace=False).astype(np.uint64))
            common = rng.integers(1, n + 1)
            most = common * 100 // percent - common  # tokens that the union may have besides
            left = int(rng.integers(0, most + 1))
            x, y = np.sort(whole[: common + left]), np.sort(np.append(whole[:common], whole[len(whole) - (most - left):] if most > left else whole[:0]))
            if len(x) == len(y) and (x == y).all():
                continue
            assert np.intersect1d(part_keys(x, percent), part_keys(y, percent)).size, (n, common, left, most)
            u, v = (np.bitwise_xor.reduce(folded(s).reshape(-1, 8), axis=0) if cut else folded(s)
                    for s in (x, y) for cut in [len(folded(x)) != len(folded(y))])
            distance = sum(bin(int(a) & (2**64 - 1)).count("1") for a in u ^ v)
            assert distance <= most


def test_bands_hold_every_pair_of_similar_sizes():
    table = bands(80, 3000)
    for a in range(1, 300):
        for b in range(a, a * 100 // 80 + 1):
            d = (a + b) * 20 // 180
            assert d == 0 or any(low <= a and b <= top and d <= most < parts for low, top, most, parts in table)


def near(seed, n, copies, share):
    base, rng = prose(seed, n), random.Random(seed)
    return [base] + [changed(base, seed * 1000 + i, max(1, int(n * share * rng.random()))) for i in range(copies)]


def test_against_all_pairs(spark):
    texts = []
    for seed, (n, copies, share) in enumerate([(9, 12, .2), (30, 20, .08), (80, 25, .06), (150, 40, .05), (400, 15, .04), (2500, 6, .03)]):
        texts += near(seed, n, copies, share)
    line = prose(99, 12)
    texts += [f"{line} {prose(200 + i, 20)}" for i in range(40)] + [f"{prose(98, 60)} {prose(300 + i, 12)}" for i in range(40)]
    texts += [prose(1, 3), prose(1, 3), prose(1, 4), prose(1, 5), prose(1, 6), prose(1, 8), prose(1, 9), texts[3].upper()]
    rows = [(500 - i, t, None, None) for i, t in enumerate(texts)]
    assert run(documents(spark, rows)) == brute(rows)
    assert run(documents(spark, rows), words=2, percent=60) == brute(rows, 2, 60)


def test_odd_rows(spark, odd, none):
    assert run(odd) == brute(odd_rows())
    assert run(none) == []
    assert jaccard_components(documents(spark, [(1, None, None, None), (2, "", None, None)])).count() == 2


def test_wanted_texts_pass_the_bit_table(spark):
    texts = spark.range(20_000).selectExpr("id", "xxhash64(id) as t1")
    wanted = texts.where("id % 100 = 3")
    kept = possible(texts, wanted)
    assert kept.columns == ["id", "t1"] and 200 <= kept.count() < 300
    assert wanted.join(kept, "id", "left_anti").count() == 0 == possible(texts, wanted.limit(0)).count()


@pytest.mark.parametrize("bits", [6, 23])
def test_rows_that_are_gone_are_left_out(spark, monkeypatch, bits):
    monkeypatch.setattr(parity, "_FILTER_BITS", bits)
    rows = spark.range(2000).selectExpr("id as row", "array(id, -id) as keys")
    gone = rows.where("row % 7 = 0").select("row")
    left = without(rows, gone)
    assert left.columns == ["row", "keys"] and sorted(r.row for r in left.collect()) == [i for i in range(2000) if i % 7]
    assert without(rows, gone.limit(0)).count() == 2000
    assert without(rows, rows.select("row")).count() == 0


def test_keys_with_the_same_sets_are_one(spark, monkeypatch):
    """Copies give keys once, and sets that share many keys meet by one: no row per key is left, yet every link."""
    written, tables = parity.materialise, {}

    def keep(df, label):
        tables[label] = written(df, label)
        return tables[label]

    monkeypatch.setattr(parity, "materialise", keep)
    texts = [*near(7, 300, 1, .02), *near(8, 300, 1, .02), *near(9, 60, 4, .05)]
    rows = [(900 - i, t, None, None) for i, t in enumerate([*texts, *texts[:4], *texts[:2]])]
    assert run(documents(spark, rows)) == brute(rows)
    stars = tables["stars"].groupBy("key").agg({"node": "collect_set"}).collect()
    groups = [tuple(sorted(r[1])) for r in stars]
    assert len(groups) == len(set(groups)) and all(len(g) > 1 for g in groups)
    assert tables["copied"].count() == 6
    assert tables["stars"].where("keys > 10").count() >= 4


def test_long_sketches_tell_how_far_sets_are_apart():
    rng = np.random.default_rng(4)
    for n, m, both in ((4000, 4000, 2500), (4000, 4400, 3800), (9000, 6500, 6400), (3, 900, 2), (70, 70, 70), (1, 1, 0), (30_000, 30_000, 25_000)):
        items = np.unique(rng.integers(0, 2**64, n + m - both, dtype=np.uint64))
        rng.shuffle(items)
        x, y = np.sort(items[:n]), np.sort(items[n - both :])
        bits = [np.frombuffer(long_sketch(v), np.uint8, offset=8) for v in (x, y)]
        apart = len(np.setxor1d(x, y))
        assert apart_at_least(*bits) == apart_at_least(*bits[::-1]) <= apart
        assert 2 * min(n, m) < max(n, m) or apart_at_least(*bits) >= apart * 0.7  # short sketches saturate at 512 bits
        assert np.frombuffer(long_sketch(x), np.int64, 1)[0] == len(x)
