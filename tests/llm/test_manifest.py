import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_helpers import documents, odd_rows, prose
from panelspark.llm import manifest as m


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level):
    """Levels of a tree, the leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + 3])))
        i //= 3
    return out


def brute(rows, change):
    """rows of (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r, sha(*map(framed, r)), sha(*map(framed, change(r)))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        leaves = sorted(by_source[name], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((leaves, up([x[1] for x in leaves])))
    top = up([t[-1][0] for _, t in trees])
    out = []
    for s, (leaves, levels) in enumerate(trees):
        for i, (r, leaf, found) in enumerate(leaves):
            steps, h = path(levels, i) + path(top, s), found
            for before, after in steps:
                h = sha(before, h, after)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], sha(*[a + b for a, b in steps]), h, h == top[-1][0]))
    return out


def without_feeds(r):
    odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
    return r if odd or r[4] is None else (*r[:4], r[4].replace("\n", ""))


def run(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = m.manifest(df, changed={"text": F.coalesce(tampered, "text")})
    return found.select("doc_id", "leaf", "subroot", "root", m.proof_digest(), "folded_root", "verified")


def same(df, rows):
    want = brute([(d, s, la, None if t is None else len(t), t) for d, t, la, s in rows], without_feeds)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in run(df).collect())


def test_odd_rows(odd, spark):
    same(odd, odd_rows())
    same(documents(spark, [(8, "a\nb", None, None)]), [(8, "a\nb", None, None)])


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_rounds_and_a_hot_source(spark, monkeypatch, levels):
    monkeypatch.setattr(m, "LEVELS", levels)
    monkeypatch.setattr(m, "CHUNK", 3**levels)
    rows = [(i, f"{prose(i % 7, 4)}\n{i}", "en", "hot") for i in range(2500 if levels == 7 else 100)]
    rows += [(i, "x\ny", None, f"s{i % 13}ü") for i in range(40)] + [(5, "same", "en", "twice")] * 4 + [(9, None, None, None)]
    same(documents(spark, rows), rows)


def test_empty_table_and_plain_verification(spark, none):
    assert run(none).count() == 0
    rows = [(i, f"t{i}\n", "en", "a") for i in range(10)]
    assert m.manifest(documents(spark, rows)).where("verified").count() == 10
    changed = m.manifest(documents(spark, rows), changed={"lang": F.when(F.col("doc_id") == 3, F.lit("fr")).otherwise(F.col("lang"))})
    assert [r["doc_id"] for r in changed.where("not verified").collect()] == [3]


def test_levels_of_a_round_share_one_shuffle(spark):
    """Windows are dealt by (tree, chunk), so that a large group is many tasks, and sorted once for all levels."""
    rows = spark.range(20_000).select(
        (F.col("id") % 2).alias("tree"), F.col("id").alias("pos"), F.lit(20_000).cast("long").alias("n"), F.lit("h").alias("h"))
    plan = m._up(rows, with_path=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(tree") == plan.count("Exchange") == plan.count("Sort [tree") == 1
