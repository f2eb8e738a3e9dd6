import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_helpers import changed, documents, odd_rows, prose
from panelspark.llm import textkit
from panelspark.llm.graph import components
from panelspark.llm.minhash import Circulant, _can_link, _compared, _described, near_duplicates, unique_documents


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        if not sets[i]:
            out.append((doc, 0, doc, True))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(i) and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((doc, len(sets[i]), low, low is None or doc == low))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_and_shingles_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(textkit, "SLICE_BYTES", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\t\n\x0b") for _ in range(rng.randrange(400))) for _ in range(60)] + ["", None, "z" * 999]
    column = pa.array(texts)
    words, bounds = textkit.word_hashes(*textkit.text_bytes(column))
    seen = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        split = re.findall(r"[^\x20\x09-\x0D]+", (text or "").replace("B", "b"))
        assert len(split) == b - a
        for w, h in zip(split, words[a:b]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for text, items in zip(texts, textkit.shingles(words, bounds, 5)):
        assert len(items) == len(shingle_set(text))


def test_signature_agrees_like_the_sets():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**64, 600, dtype=np.uint64)])  # 2400 of 3600 in common
    maker = Circulant(512, 4, 1)
    agree = np.mean(maker.signature(a) == maker.signature(b))
    assert abs(agree - 2400 / 3600) < 0.07


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for k in range(40):
        base = prose(k, rng.choice([3, 5, 7, 30, 120]))
        rows += [(len(rows), base, None, None)]
        for _ in range(rng.randrange(6)):
            n = len(base.split())
            rows.append((len(rows), changed(base, len(rows), rng.randrange(0, max(1, n // 18) + 1)), None, None))
    chain = prose(99, 100).split()  # neighbours are near, the ends are not
    rows += [(len(rows) + k, " ".join(chain[k * 5 :] + [f"t{i}" for i in range(k * 5)]), None, None) for k in range(10)]
    rng.shuffle(rows)
    assert got(near_duplicates(documents(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")) == expected(rows)


def test_odd_input(odd, none):
    assert got(near_duplicates(odd)) == expected(odd_rows())
    assert got(near_duplicates(none)) == []
    kept = unique_documents(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert unique_documents(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(500, 501 + i) for i in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 200: 100} | {500 + i: 500 for i in range(51)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hub_bound_never_rules_out_a_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    sets = [np.sort(base)]
    for _ in range(40):
        kept = base[rng.random(150) > rng.uniform(0, 0.3)]
        pool = sets[rng.integers(len(sets))]  # what is new is partly shared with others
        sets.append(np.unique(np.concatenate([kept, rng.choice(pool, 20), rng.integers(0, 2**64, rng.integers(0, 30), dtype=np.uint64)])))
    table = spark.createDataFrame([(bytes([i]) * 16, s.tobytes()) for i, s in enumerate(sets)], "set_id binary, items binary")
    hub = bytes([0]) * 16
    pairs = table.select(F.col("set_id").alias("a"), F.lit(bytearray(hub)).alias("b")).where("a <> b")
    about = _described(_compared(pairs, table, 75))
    u, v = about.alias("u"), about.alias("v")
    possible = {(r[0][0], r[1][0]) for r in u.join(v, _can_link(75)).select("u.set_id", "v.set_id").collect()}
    linked = {(i, j) for i in range(1, 41) for j in range(1, 41)
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= possible and len(possible) < 1600 * 0.8
