import random
from collections import defaultdict

import pytest

from llm_helpers import documents, odd_rows, prose
from panelspark.llm.mixing import fit_lengths, mix_sources, mixed_documents


def size(text):
    return len([w for w in (text or "").replace("\x0b", " ").split() if w])


def targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: (sizes[s], 2.0 * sizes[s] if s in full else level * weight[s]) for s in order}
        full |= over


def check(df, rows, slack):
    got = df.collect()
    assert len(got) == len(rows)
    want = targets(rows)
    source = {d: s for d, _, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        total, target = want[source[r["doc_id"]]]
        assert r["source_size"] == total and r["target"] == pytest.approx(target)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, *_ in rows)
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= slack


def test_targets_and_budgets(spark):
    rng = random.Random(4)
    names = ["b", "a", None, "é", "Z", "tiny"]
    rows = [(i, prose(i, rng.randrange(1, 60)), None, rng.choice(names[:5])) for i in range(900)] + [(990, "one", None, "tiny")]
    df = mix_sources(documents(spark, rows))
    check(df, rows, 1)
    again = mix_sources(documents(spark, rows).repartition(3))
    assert sorted(map(str, df.collect())) == sorted(map(str, again.collect()))
    whole = mixed_documents(documents(spark, rows))
    copies = {r["doc_id"]: r["copies"] for r in df.collect() if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in whole.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == copies


def test_many_of_one_length(spark):
    rows = [(i, prose(i, 10), None, "a" if i % 3 else "b") for i in range(3000)]
    check(mix_sources(documents(spark, rows)), rows, 10)


def test_odd_input(odd, none):
    assert mix_sources(odd).count() == len(odd_rows())
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0
    want = targets(odd_rows())
    got = mix_sources(odd).collect()
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(a, round(b, 6)) for a, b in want.values()}
    assert mixed_documents(odd).columns == odd.columns + ["__copy"]  # the table has a _copy of its own
    assert mixed_documents(odd.drop("_copy")).columns == odd.drop("_copy").columns + ["_copy"]


def best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


def test_fit_is_a_best_fit_within_the_window():
    rng = random.Random(8)
    for k in range(60):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 6)))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(sum(n * c for n, c in zip(lengths, counts)) + 2)
        take = fit_lengths(lengths, counts, budget, k)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        used = sum(n * t for n, t in zip(lengths, take))
        assert used <= budget
        even = [c * budget // max(1, sum(n * c for n, c in zip(lengths, counts))) for c in counts]
        if all(e == 0 for e in even) or used == budget:
            assert used == best_sum(lengths, counts, budget)
    assert fit_lengths([50_000], [3], 120_000, 1) == [2]
    assert sum(n * t for n, t in zip([7, 30_000], fit_lengths([7, 30_000], [10_000, 50], 777_777, 1))) in range(777_770, 777_778)
