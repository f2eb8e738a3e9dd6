"""Quality rules: a decision list of threshold conditions, learned from labelled document statistics.

The statistics are column expressions. Sequential covering grows one conjunction at a time on two thirds of the
labelled rows and prunes it on the rest; each step is one aggregate over all labelled rows, and what reaches the
driver is a count per feature value, of which there are at most some thousands because values are kept to two
digits. The result is an ordered chain of Spark conditions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.exprs import SPACES, count_of, let, text_or_empty, words
from panelspark.session import materialise

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_words", "f_length", "f_symbols", "f_marks", "f_upper", "f_dup_lines", "f_repeats"]


def _repeat_words(ws: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the list.

    Window hashes are sorted with the position in their low bits; neighbours with equal whole hashes repeat.
    """

    def covered(h: Column) -> Column:
        return let((F.pow(F.lit(2.0), F.ceil(F.log2(F.size(h) + 1))) - 1).cast("long"), lambda low: let(
            F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))),
            lambda s: let(
                F.filter(s, lambda x, i: _same(h, s, x, i - 1, low) | _same(h, s, x, i + 1, low)),
                lambda r: F.size(F.array_distinct(F.flatten(F.transform(
                    r, lambda x: F.sequence(x.bitwiseAND(low), x.bitwiseAND(low) + 2))))))))

    def windows(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(k) - 3), lambda i: F.xxhash64(k[i], k[i + 1], k[i + 2]))

    distinct = let(windows(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(ws) < 4, 0).otherwise(distinct).cast("long")


def _same(h: Column, s: Column, x: Column, i: Column, low: Column) -> Column:
    near = F.get(h, F.get(s, i).bitwiseAND(low).cast("int"))
    return F.coalesce(near == F.get(h, x.bitwiseAND(low).cast("int")), F.lit(False))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _two_digits(value: Column) -> Column:
    """Value cut to two significant digits; under a thousandth it is 0."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value >= 0.001, F.round(F.floor(value / unit) * unit, 6)).otherwise(0.0)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add COUNTS (long) and FEATURES (double, two digits) of each whole text; null counts as empty.

    Words are runs of anything but ASCII white space. n_dup_lines counts lines with a word that equal an earlier
    line, n_repeat_words the words in 3-word windows found at least twice.
    """
    text = F.col("_text")
    counted = docs.withColumn("_text", text_or_empty(text_col)).withColumns({
        "_words": let(words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeats"))),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": count_of(text, SYMBOLS),
        "n_dup_lines": _dup_lines(text),
        "_marks": count_of(text, "!?~^=_{}[]\\"),
        "_upper": count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_lines": F.size(F.split(text, "\n")),
    }).withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.repeats")})
    per_word = F.greatest("n_words", F.lit(1))
    return counted.withColumns({
        "f_words": _two_digits(F.col("n_words").cast("double")),
        "f_length": _two_digits(F.col("word_chars") / per_word),
        "f_symbols": _two_digits(F.col("n_symbols") / per_word),
        "f_marks": _two_digits(F.col("_marks") / per_word),
        "f_upper": _two_digits(F.col("_upper") / F.greatest("word_chars", F.lit(1))),
        "f_dup_lines": _two_digits(F.col("n_dup_lines") / F.col("_lines")),
        "f_repeats": _two_digits(F.col("n_repeat_words") / per_word),
    }).drop("_text", "_words", "_marks", "_upper", "_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Condition, ...]


def matches(rule: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def first_rule(rules: Sequence[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(matches(rule), i).otherwise(out)
    return out


def _best_condition(rows: DataFrame, features: Sequence[str]) -> tuple[Condition | None, int, int]:
    """Condition with the highest information gain over ``rows`` (columns bad and the features)."""
    pairs = ", ".join(f"'{f}', {f}" for f in features)
    counts = (
        rows.selectExpr("bad", f"stack({len(features)}, {pairs}) as (feature, value)")
        .groupBy("feature", "value").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        .orderBy("feature", "value").collect()
    )
    best, choice = 1e-9, None
    pos = neg = 0
    for feature in features:
        values = [r for r in counts if r["feature"] == feature]
        pos, neg = sum(r["p"] for r in values), sum(r["n"] for r in values)
        if pos == 0:
            continue
        base = math.log2(pos / (pos + neg))
        p = n = 0
        for last, r in zip(values, values[1:]):
            p, n = p + last["p"], n + last["n"]
            for at_least, hits, misses in ((False, p, n), (True, pos - p, neg - n)):
                gain = hits * (math.log2(hits / (hits + misses)) - base) if hits else 0.0
                if gain > best:
                    best, choice = gain, Condition(feature, at_least, r["value"])
    return choice, pos, neg


def learn_rules(
    labelled: DataFrame, features: Sequence[str] = FEATURES, *, max_rules: int = 8, max_conditions: int = 4,
    min_precision: float = 0.95, min_cover: int = 5,
) -> list[Rule]:
    """Ordered rules for rows with ``bad`` true, by sequential covering over all rows of ``labelled``.

    ``labelled`` has the boolean columns bad and prune (the part to prune on) and the features, and is read once
    per step: hand in a stored table. A rule is kept if it covers at least ``min_cover`` rows of the pruning part with at
    least ``min_precision`` of them bad; the first rule that fails ends the list. No bad row gives no rules.
    """
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.where(~F.coalesce(first_rule(rules) > 0, F.lit(False))) if rules else labelled
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            choice, pos, neg = _best_condition(left.where(~F.col("prune")).where(matches(grown)), features)
            if choice is None or pos == 0 or neg == 0 and grown:
                break
            grown.append(choice)
        if not grown:
            break
        held = left.where("prune").agg(*[
            F.count_if(matches(grown[:k]) & (F.col("bad") if hit else ~F.col("bad"))).alias(f"{'pn'[not hit]}{k}")
            for k in range(1, len(grown) + 1) for hit in (True, False)
        ]).first()
        worth = [(held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]) for k in range(1, len(grown) + 1)]
        k = worth.index(max(worth)) + 1
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p + n < min_cover or p < min_precision * (p + n):
            break
        rules.append(tuple(grown[:k]))
    return rules


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    *, label_id: str = "doc_id", **learner,
) -> DataFrame:
    """(id, COUNTS, base_failed, kept, rule) for every row of ``docs``.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept is false if
    base_failed or a learned rule holds (rule is its number). Labels: 0 is bad; rows without a label or without
    a document are not learned from, and a document labelled twice counts as bad if any label says so. Null and
    empty texts have counts 0 and fail; equal rows get equal results; other columns are not read; without
    labels only the base decides.
    """
    stats = materialise(
        text_statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw")), "_raw").drop("_raw"),
        "statistics")
    rules = _learned(stats, labels, label_col, label_id, learner)
    return stats.select(
        F.col("_id").alias(id_col), *COUNTS, _failed().alias("base_failed"), first_rule(rules).alias("rule")
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def passing_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    *, label_id: str = "doc_id", **learner,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    One pass learns the rules, a second one filters the rows in place, so no text is shuffled.
    """
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    rules = _learned(text_statistics(narrow, "_raw").drop("_raw"), labels, label_col, label_id, learner)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_raw"))
    return text_statistics(rows, "_raw").where(~_failed() & first_rule(rules).isNull()).select("_row.*")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _learned(stats: DataFrame, labels: DataFrame, label_col: str, label_id: str, learner: dict) -> list[Rule]:
    known = labels.groupBy(F.col(label_id).alias("_id")).agg(F.min(label_col).alias("_label")).where("_label is not null")
    labelled = materialise(
        stats.join(known, "_id").select(
            (F.col("_label") == 0).alias("bad"), (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("prune"), *FEATURES),
        "labelled")
    return learn_rules(labelled, **learner)
