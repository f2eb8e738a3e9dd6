"""Mix sources to target weights by fitting each source's word budget exactly.

Documents are counted by (source, exact length). Per source, whole copies and an even share of every length come
first; a bounded-knapsack dynamic program over the lengths left then hits the remaining budget as closely as any
choice of documents can within its window. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.exprs import text_or_empty, words
from panelspark.operators.ordering import ordered_index
from panelspark.session import materialise

WINDOW = 1 << 14  # the dynamic program runs over at most so many words of remaining budget
_PER_BUCKET = 500  # rows of equal source and length that are ranked together, on average


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take so that the words come as near below ``budget`` as found.

    Every length gives its even share (rounded down), then one more in seeded order, then as many as fit from the
    longest down, while more than WINDOW words are missing; the rest is a bounded subset-sum solved exactly.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    spots = [int(i) for i in np.random.default_rng(seed).permutation(len(lengths))]
    longest = sorted(spots, key=lambda i: -lengths[i])
    for order, most in ((spots, 1), (longest, None)):
        for i in order:
            if rest <= WINDOW:
                break
            more = min(counts[i] - take[i], rest // lengths[i], most or rest)
            take[i] += more
            rest -= more * lengths[i]
    if rest > WINDOW:  # every length left is longer than what is missing
        return take

    reach, mask, steps = 1, (1 << (rest + 1)) - 1, []
    for i in spots:
        left, k = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:  # a count is split into 1, 2, 4, ... and what remains
            k = min(k, left)
            steps.append((i, k, reach))
            reach |= reach << k * lengths[i] & mask
            left, k = left - k, 2 * k
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def source_key(source: str) -> Column:
    """Source as a value that joins and groups also where it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def draw(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in docs.columns])


def source_targets(sources: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """Add target to (key, source, source_size): shares of percent of all words by weight.

    Weights go round over the sources by code point, null last. A target stops at ``most`` times its source's
    size; the excess is shared by weight among the others until none is above.
    """
    ranked = ordered_index(sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("key", "source_size", weight.alias("weight"),
                                       (most * F.col("source_size")).cast("double").alias("cap")), "sources")
    size = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = size * percent / 100, 0.0
    while True:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        full, free = ranked.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free or (budget - (full or 0.0)) / free <= level:
            break
        level = (budget - (full or 0.0)) / free
    return ranked.select("key", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def fit_plan(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(key, size, source_size, target, copies, last): documents of that source and size are taken ``copies``
    times, and once more if their draw is not above ``last`` (null: no more)."""

    def fit(groups: pd.DataFrame) -> pd.DataFrame:
        whole, goal = int(groups["source_size"].iloc[0]), int(groups["goal"].iloc[0])
        groups = groups.sort_values("size")
        copies = goal // whole if whole else 0
        used = groups["size"].to_numpy() > 0
        lengths, counts = (groups[c].to_numpy()[used].tolist() for c in ("size", "n"))
        extra = np.zeros(len(groups), np.int64)
        if lengths:
            extra[used] = fit_lengths(lengths, counts, goal - copies * whole, seed)
        return groups.assign(copies=copies, extra=extra)[["key", "size", "n", "source_size", "target", "copies", "extra"]]

    counts = sized.groupBy("key", "size").agg(F.count("*").alias("n"))
    plan = materialise(
        counts.join(targets.withColumn("goal", F.round("target").cast("long")), "key").groupBy("key").applyInPandas(
            fit, "key string, size long, n long, source_size long, target double, copies long, extra long"), "plan")

    # The draw of the last document taken, where only some of a length are: found by buckets of draws first.
    part = plan.where("extra > 0 and extra < n").select("key", "size", "extra", F.ceil(F.col("n") / _PER_BUCKET).alias("k"))
    bucket = F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * F.col("k"))
    rows = sized.join(part, ["key", "size"]).withColumn("bucket", bucket)
    by_length = W.partitionBy("key", "size").orderBy("bucket")
    filled = rows.groupBy("key", "size", "extra", "bucket").agg(F.count("*").alias("m")).withColumn(
        "upto", F.sum("m").over(by_length))
    edge = filled.where("upto >= extra and upto - m < extra").select(
        "key", "size", "bucket", (F.col("extra") - F.col("upto") + F.col("m")).alias("place"))
    place = F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("draw"))
    last = (
        rows.drop("extra", "k").join(edge, ["key", "size", "bucket"]).withColumn("i", place)
        .where("i = place").select("key", "size", F.col("draw").alias("last"))
    )
    return plan.join(last, ["key", "size"], "left").select(
        "key", "size", "source_size", "target",
        (F.col("copies") + (F.col("extra") >= F.col("n")).cast("long")).alias("copies"), "last")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 11,
) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for every row of ``docs``.

    size counts words (null text: 0), target is the row's source's, copies how often the mix takes the row (0 to
    ``most``) and taken the words of that. Sources by code point weigh ``weights`` in turn, null is a source of its
    own and the last; they share ``percent`` of all words. The draw depends on seed, id, source and text, so reruns
    agree and equal rows share their fate; only where equal rows end a source's choice can it pass its target by
    them. Documents without words are never taken more than whole copies of their source, empty tables give empty
    ones; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized = materialise(narrow.select(
        "id", "source", source_key("source").alias("key"),
        F.size(words(text_or_empty("text"))).cast("long").alias("size"), draw(narrow, seed).alias("draw")), "sized")
    plan = _plan(sized, weights, percent, most, seed)
    return _applied(sized, plan).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def _plan(sized: DataFrame, weights: Sequence[int], percent: int, most: int, seed: int) -> DataFrame:
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    return fit_plan(sized.select("key", "size", "draw"), source_targets(sources, weights, percent, most), seed)


def _applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (key, size, draw and others) with their source's figures, copies and taken."""
    copies = F.col("copies") + F.coalesce(F.col("draw") <= F.col("last"), F.lit(False)).cast("long")
    return rows.join(plan, ["key", "size"]).withColumn("copies", copies).withColumn(
        "taken", F.col("size") * F.col("copies"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 11,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_sources`` takes it, with its number ``_copy`` from 1.

    All columns of ``docs`` stay; where one of them has that name, the number's name starts with more underscores. Rows
    without words are left out.
    """
    number, taken_names = "_copy", {c.lower() for c in docs.columns}
    while number in taken_names:
        number = f"_{number}"
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    size = F.size(words(text_or_empty("text"))).cast("long").alias("size")
    sized = materialise(narrow.select(
        "source", source_key("source").alias("key"), size, draw(narrow, seed).alias("draw")), "sized")
    plan = _plan(sized, weights, percent, most, seed)
    rows = docs.select(F.struct("*").alias("_row"), *[
        F.col(c).alias(n) for n, c in (("id", id_col), ("source", source_col), ("text", text_col))])
    rows = rows.select("_row", source_key("source").alias("key"), size, F.xxhash64(
        F.lit(seed), "id", "source", "text").alias("draw"))
    taken = _applied(rows, plan).where("taken > 0")
    return taken.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(number))
