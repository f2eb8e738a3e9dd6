import random

import numpy as np
import pyarrow as pa

from llm_helpers import changed, documents, odd_rows, prose
from panelspark.llm import contamination
from panelspark.llm.contamination import EDIT_RATE, GRAM, LEAST, SEGMENT, SegmentIndex, benchmark_matches, decontaminated, reduced


def plain(text):
    out = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or ""))
    return " ".join("".join(c.lower() if c.isascii() else c for c in out).split()).encode()


def nearest(segment, text):
    """Least edits between a segment and any part of a text."""
    row = np.zeros(len(text) + 1, int)
    letters = np.frombuffer(text, np.uint8)
    for i, b in enumerate(segment):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (letters != b), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min()


def expected(docs, items):
    out = set()
    for doc, text, *_ in docs:
        for item, passage in items:
            whole = plain(passage)
            if len(whole) < LEAST:
                continue
            last = max(0, len(whole) - SEGMENT)
            for at in {*range(0, last, SEGMENT // 2), last}:
                part = whole[at : at + SEGMENT]
                if nearest(part, plain(text)) <= min(int(EDIT_RATE * len(part)), (len(part) - GRAM) // GRAM):
                    out.add((doc, item))
    return out


def typos(text, n, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], ["q"], [out[i], "z"]])
    return "".join(out)


def cases():
    items = [(i, prose(1000 + i, 5 + 3 * i) + ("é" if i % 2 else "")) for i in range(10)] + [(50, "short"), (51, None), (52, "")]
    rows = []
    for i in range(60):
        text = prose(i, 40)
        if i % 2:
            item = items[i % 10][1]
            cut = item[len(item) // 3 :] if i % 5 == 0 else item
            text = text[:70] + " " + typos(cut.upper() if i % 3 else cut.replace(" ", "\n, "), i % 7, i) + "! " + text[70:]
        rows.append((i, text, None, None))
    return rows, items


def test_against_brute_force(spark, monkeypatch):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_matches(documents(spark, rows), table)
    want = expected(rows, items)
    assert 20 < len(want)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    clean = decontaminated(documents(spark, rows), table)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 900)  # several blocks, and items cut into pieces
    monkeypatch.setattr(contamination, "PIECE_CHARS", 400)
    found = benchmark_matches(documents(spark, rows), table)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_spans_and_repeats(spark):
    item = prose(5, 30)
    text = "ä " * 50 + item + " x"
    raw = text.encode()
    ((row, _, edits, start, end), *_) = SegmentIndex([(1, item)]).search(pa.array([text]))
    assert edits == 0 and raw[start:end].decode().strip() in item and row == 0
    rows = [(1, text, None, None), (1, text, None, None), (None, text, None, None), (2, changed(text, 1, 40), None, None)]
    items = spark.createDataFrame([(1, item), (2, item), (None, item)], "item_id long, text string")
    assert benchmark_matches(documents(spark, rows), items).count() >= 9


def test_odd_input(spark, odd, none):
    items = spark.createDataFrame([(1, prose(2, 80)), (2, None)], "item_id long, text string")
    assert [r["doc_id"] for r in benchmark_matches(odd, items).collect()] == [None, None]
    assert decontaminated(odd, items).count() == len(odd_rows()) - 2
    assert benchmark_matches(none, items).count() == 0 and decontaminated(none, items).count() == 0
    assert benchmark_matches(odd, items.limit(0)).count() == 0 and decontaminated(odd, items.limit(0)).count() == len(odd_rows())


def test_reduced_texts():
    texts = ["A, b", "", "  x--Y", "é\n", "q"]
    data, starts, _ = reduced(*__import__("panelspark.llm.textkit", fromlist=["x"]).text_bytes(pa.array(texts)))
    parts = [bytes(data[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    assert [p.rstrip() for p in parts] == [plain(t) for t in texts]


def test_short_items_replaced_words_and_inner_excerpts():
    words = "the quick brown foxes jump over lazy dogs while seven happy wizards cook fresh bread under old wooden bridges near quiet rivers".split()
    replaced = [w if i % 12 != 5 else "xqzvkj" for i, w in enumerate(words)]
    items = [("short", "What is the capital of France?"), ("long", " ".join(words))]
    noise = prose(3, 30)
    texts = [f"{noise} what is the Capital of France {noise}", f"{noise} {' '.join(replaced)} {noise}",
             f"{noise} {' '.join(words[3:20])} {noise}", noise, f"{noise} What is it {noise}"]
    found = {(row, item) for row, item, *_ in SegmentIndex(items).search(pa.array(texts))}
    assert found == {(0, "short"), (1, "long"), (2, "long")}
