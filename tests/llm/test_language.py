import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from llm_helpers import documents, odd_rows
from panelspark.llm import language
from panelspark.llm.language import ContextTrees, context_counts, identify_languages, learn_languages
from panelspark.llm.textkit import text_bytes

SYLLABLES = {"aa": "ka to mi ru se no", "bb": "gle pfu sch tze ung ver", "cc": "né où çan eau que ç", "dd": "ка то ми ру се но"}


def text(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def code_length(train, data):
    """The model's bits, context by context."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        padded = b"\0\0\0" + t.encode()
        for i in range(3, len(padded)):
            for k in range(4):
                counts[k][padded[i - k : i]][padded[i]] += 1
    padded, bits = b"\0\0\0" + data.encode(), 0.0
    for i in range(3, len(padded)):
        for k in range(3, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts[k].get(padded[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if padded[i] in seen:
                bits -= math.log2(seen[padded[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def test_exact_code_lengths(spark, monkeypatch):
    train = {k: [text(k, s, 30) for s in range(5)] + ["x\0y"] for k in SYLLABLES}
    rows = spark.createDataFrame([(k, t) for k, ts in train.items() for t in ts], "lang string, text string")
    monkeypatch.setattr(language, "_BLOCK", 50)
    model = learn_languages(rows)
    assert model.langs == sorted(SYLLABLES)
    tests = [text("aa", 77, 20), text("dd", 5, 10), "", "completely other text éÿ 漢", "\0\0a", "k"]
    bits = model.code_lengths(*text_bytes(pa.array(tests)))
    want = [[code_length(train[k], t) for k in model.langs] for t in tests]
    assert np.allclose(bits, want, rtol=1e-5, atol=1e-4)


def test_counts_are_of_all_texts(spark):
    rows = spark.createDataFrame([("a", "abab"), ("a", "ab"), ("b", "ab")], "lang string, text string")
    got = {(r["lang"], r["gram"]): r["n"] for r in context_counts(rows).collect()}
    assert got["a", 97] == 2 and got["a", 98 + 97 * 256] == 2 and got["b", 97] == 1 and sum(got.values()) == 8


def test_pruning_keeps_the_frequent(spark):
    rows = spark.createDataFrame([("a", "abc" * 50 + text("bb", 1, 50))], "lang string, text string")
    small, full = learn_languages(rows, 12), learn_languages(rows)
    assert 0 < len(small.levels[3][0]) <= 12 < len(full.levels[3][0])


def test_held_out_accuracy(spark):
    rows = [(i, text(k, i, 5 + i % 30), k if i % 9 else None, None) for i in range(300) for k in [sorted(SYLLABLES)[i % 4]]]
    got = identify_languages(documents(spark, rows)).collect()
    assert len(got) == 300
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert np.mean([r["lang_pred"] == sorted(SYLLABLES)[r["doc_id"] % 4] for r in got]) > 0.99


def test_odd_input(odd, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in identify_languages(odd).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (None, "und")} <= got
    assert (8, "ru") in got or (8, "en") in got  # learned from only if it is not held out
    assert identify_languages(odd).count() == len(odd_rows())
    assert identify_languages(none).count() == 0
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(unlabelled).collect()} == {("und", 0.0)}


def test_empty_model():
    assert ContextTrees([], *(np.zeros(0, t) for t in (np.int64, np.uint32, float))).langs == []


def test_pruning_keeps_every_language(spark):
    rows = [("aa", text("aa", s, 400)) for s in range(40)] + [("bb", text("bb", s, 400)) for s in range(40)] + [("cc", text("cc", 1, 12))]
    table = spark.createDataFrame(rows, "lang string, text string")
    model = learn_languages(table, 900)
    assert model.langs == ["aa", "bb", "cc"]
    assert 3 * len(model.levels[3][0]) <= 900
    bits = model.code_lengths(*text_bytes(pa.array([text("cc", 9, 20)])))
    assert model.langs[int(bits.argmin())] == "cc"


def test_shares_use_what_small_languages_leave():
    assert language.shares({"a": 10, "b": 1000, "c": 1000}, 300) == {"a": 10, "b": 145, "c": 145}
    assert language.shares({"a": 10, "b": 20}, 100) == {"a": 10, "b": 20}
    assert language.shares({"a": 10, "b": 20}, 1) == {"a": 1, "b": 1}
