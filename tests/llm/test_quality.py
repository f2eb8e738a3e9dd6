import re
from collections import Counter

from llm_helpers import documents, odd_rows, prose
from panelspark.llm.quality import COUNTS, Condition, learn_rules, passing_documents, quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def sample():
    rows, labels = [], []
    for i in range(240):
        text = prose(i, 90)
        if i % 3 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 7 == 0:
            text = "\n".join([text.upper()] * 1)
        rows.append((i, text, None, None))
        labels.append((i, int(i % 3 != 0 and i % 7 != 0)))
    rows += [(900, "a b c a b c d e " * 20, None, None), (901, "x\ny\nx\n \n \nx 🎈 # é\x0b<" + prose(7, 60), None, None)]
    return rows, labels


def test_counts_and_rules(spark):
    rows, labels = sample()
    docs = documents(spark, rows)
    found = quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        assert tuple(got[doc][c] for c in COUNTS) == counts(text), doc
        assert got[doc]["base_failed"] == failed(counts(text))
    assert all(got[d]["kept"] == bool(q) for d, q in labels)
    kept = passing_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}


def test_odd_input(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality_rules(odd, no_labels)
    want = sorted((d or 0, *counts(t), failed(counts(t)), not failed(counts(t))) for d, t, *_ in odd_rows())
    assert sorted((r["doc_id"] or 0, *[r[c] for c in COUNTS], r["base_failed"], r["kept"]) for r in found.collect()) == want
    strange = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (77, 1), (2, None)], "doc_id long, quality int")
    assert quality_rules(odd, strange).count() == len(odd_rows())
    assert quality_rules(none, strange).count() == 0
    assert passing_documents(odd, no_labels).count() == sum(w[-1] for w in want)


def test_rule_list(spark):
    rows = [(x > 5 and y < 2, i % 3 == 0, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(10) for y in range(10))] * 3
    table = spark.createDataFrame(rows, "bad boolean, prune boolean, f double, g double")
    assert learn_rules(table, ["f", "g"]) == [(Condition("g", False, 2.0), Condition("f", True, 6.0))]
    assert learn_rules(table.where("not bad"), ["f", "g"]) == []
    assert learn_rules(table.limit(0), ["f", "g"]) == []
