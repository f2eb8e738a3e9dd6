import re

import pytest

from llm_helpers import documents, prose
from panelspark.llm.licenses import PERCENT, TEMPLATES, scan_licenses

LONG = TEMPLATES[2][1]


def shingles(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def expected(rows):
    """Licenses of which a template's shingles are in the whole text (texts here hold a notice once)."""
    return {
        (doc, name) for doc, text, *_ in rows for name, template in TEMPLATES
        if 100 * len(shingles(template) & shingles(text)) >= PERCENT * len(shingles(template))
    }


def cases():
    rows = []
    for i, (_, template) in enumerate(TEMPLATES):
        for k in range(8):  # every place relative to the windows
            rows.append((100 * i + k, f"{prose(i, 20 + k)} {template.upper() if k % 2 else template} {prose(k, 30)}", None, None))
        words = template.replace(".", "").split()
        rows.append((100 * i + 50, " ".join(w + "###" for w in words), None, None))
        if len(words) > 30:
            rows.append((100 * i + 60, " ".join(["x"] + words[: len(words) // 2] + ["changed"] + words[len(words) // 2 + 1 :]), None, None))
            rows.append((100 * i + 61, " ".join(words[: len(words) // 2]), None, None))
    rows += [(5000 + i, prose(i, 200), None, None) for i in range(20)] + [(6000, "under the license", None, None)]
    return rows


def test_all_templates(spark):
    rows = cases()
    found = {(r["doc_id"], r["license"]) for r in scan_licenses(documents(spark, rows)).collect()}
    assert found == expected(rows)


def test_place_and_repeats(spark):
    text = prose(1, 40) + " " + LONG
    rows = [(1, text, None, None), (1, text, None, None), (2, (LONG + " ") * 50, None, None), (None, text, None, None)]
    got = {r["doc_id"]: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert len(got) == 3 and got[1]["percent"] == 100 and abs(got[1]["first_word"] - 40) <= 8
    assert got[2]["n_windows"] > 40 * got[1]["n_windows"] / 2


def test_native_and_odd(spark, odd, none):
    plan = scan_licenses(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0
    assert scan_licenses(odd, templates=[("A", "b c")]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_texts(spark, n):
    assert scan_licenses(documents(spark, [(1, " ".join("abc"[:n]), None, None)]), templates=[("L", "a b c")]).count() == (n == 3)
