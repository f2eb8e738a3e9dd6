"""License notices in documents: MinHash over overlapping word windows, then exact containment.

All of it is column expressions. Each window of a document has one MinHash value per band, and a window of a
template with an equal value makes a candidate. A candidate counts if enough of the whole template's shingles
are in the document around the window.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.exprs import let, text_or_empty

SHINGLE = 3  # words
WINDOW = 6  # shingles of a window, that is 8 words
STRIDE = 4  # words from window to window: a notice of 5 words lies whole in one of them
BANDS = 16  # of one value each: a window with half of its shingles in common is found but for 2 ** -16
PERCENT = 80  # of a template's shingles
MOST_TEMPLATE_WORDS = 10_000  # of templates that are searched in one pass: their windows are broadcast

# Usual notices and opening sentences of public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
                "version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
                "version 2 of the License, or (at your option) any later version."),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def shingle_hashes(text: str) -> Column:
    """Hash of every run of SHINGLE words of a text; a word is a lower-case run of anything but ASCII punctuation."""
    words = F.filter(F.split(F.lower(text_or_empty(text)), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))))


def windows(hashes: str, stride: int) -> Column:
    """Runs of WINDOW hashes from every ``stride``-th on, as (at, h0, h1, ...); short runs repeat their first hash."""
    def window(h: Column, i: Column) -> Column:
        run = [F.coalesce(F.get(h, i + k), F.get(h, i), F.lit(0).cast("long")).alias(f"h{k}") for k in range(WINDOW)]
        return F.struct(i.alias("at"), *run)

    none = F.filter(F.array(window(F.array(F.lit(0).cast("long")), F.lit(0))), lambda w: F.lit(False))
    return let(F.col(hashes), lambda h: F.when(F.size(h) == 0, none).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(h) - 1, F.lit(stride)), lambda i: window(h, i))))


def band_values() -> list[Column]:
    """MinHash value of a window (h0, h1, ...) in each band.

    The hashes are uniform, so hash XOR a constant orders them anew for every constant.
    """
    masks = np.random.default_rng(41).integers(-(2**63), 2**63, BANDS, dtype=np.int64).tolist()
    return [F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(mask)) for k in range(WINDOW)]) for mask in masks]


def band_keys() -> Column:
    return F.array(*[F.struct(F.lit(band).alias("band"), v.alias("value")) for band, v in enumerate(band_values())])


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, shingles): the templates that have shingles."""
    rows = json.dumps([{"template": i, "license": name, "text": text} for i, (name, text) in enumerate(templates)])
    parsed = F.from_json(F.lit(rows), "array<struct<template int, license string, text string>>")
    table = spark.range(1, numPartitions=1).select(F.inline(parsed))
    return table.select("template", "license", shingle_hashes("text").alias("shingles")).where("size(shingles) > 0")


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, license, n_windows, first_word, percent) for every row of ``docs`` and license found in it.

    A template is found where a window of the text shares a band with one of the template's windows and at least
    ``percent`` of the template's distinct shingles occur within the longest template's length of that window. n_windows
    counts such windows over the license's templates, first_word is the first one's place (a word number from 0)
    and percent the highest containment. Null and empty texts and templates of fewer than SHINGLE words match nothing; rows
    with equal ids and texts are reported once; a null id stays null; other columns are not read; an empty table gives an
    empty one. Texts are read once and not shuffled; templates are taken in blocks of up to
    MOST_TEMPLATE_WORDS words, one pass each.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), shingle_hashes(text_col).alias("hashes"))
    blocks: list[list[tuple[str, str]]] = [[]]
    words = 0
    for name, text in templates:
        words += len(text.split())
        if words > MOST_TEMPLATE_WORDS and blocks[-1]:
            blocks.append([])
            words = len(text.split())
        blocks[-1].append((name, text))
    found = reduce(DataFrame.union, [_contained(rows, template_table(docs.sparkSession, b)) for b in blocks])
    return found.where(F.col("percent") >= percent).groupBy("id", "tag", "license").agg(
        F.countDistinct("at").alias("n_windows"), F.min("at").cast("long").alias("first_word"),
        F.max("percent").alias("percent"),
    ).drop("tag").withColumnRenamed("id", id_col)


def _contained(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, tag, at, license, percent) of every candidate window and template of one block."""
    keys = known.select("template", F.inline(windows("shingles", 1))).select("template", F.inline(band_keys())).distinct()
    per_band = keys.groupBy("band").agg(F.collect_set("value").alias("values")).collect()  # bounded by the block
    values = {r["band"]: sorted(r["values"]) for r in per_band}
    margin = known.agg(F.max(F.size("shingles"))).first()[0] or 0

    # The windows are made first, so that inlining, the filter and the slice compile into one loop in which
    # the hashes are not copied. (An inner inline would have its array computed once more, as a filter on its size.)
    cut = rows.withColumn("windows", windows("hashes", STRIDE)).select("id", "tag", "hashes", F.inline_outer("windows"))
    hit = reduce(operator.or_, [v.isin(values[b]) for b, v in enumerate(band_values()) if b in values], F.lit(False))
    first = F.greatest(F.col("at") + 1 - margin, F.lit(1))
    around = F.slice("hashes", first, WINDOW + 2 * margin).alias("around")
    candidates = cut.where(hit).select("id", "tag", "at", around, *[f"h{k}" for k in range(WINDOW)])
    matched = candidates.select("id", "tag", "at", "around", F.inline(band_keys())).join(
        F.broadcast(keys), ["band", "value"]).dropDuplicates(["id", "tag", "at", "template"])
    distinct = F.array_distinct("shingles")
    share = 100 * F.size(F.array_intersect(distinct, F.col("around"))) / F.size(distinct)
    return matched.join(F.broadcast(known), "template").select("id", "tag", "at", "license", share.alias("percent"))
