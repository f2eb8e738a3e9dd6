"""Language by prediction by partial matching over bytes.

Every language has a context tree of up to three preceding bytes with the counts of what followed, gathered once and
then frozen. A byte's code length is -log2 of its share in the longest context in which it was seen, plus the
escapes from the longer contexts in which it was not; a context with n bytes after it, d of them distinct, gives
a byte seen k times k / (n + d) and the escape d / (n + d). The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textkit import slices, text_bytes
from panelspark.session import materialise

ORDER = 3
MODEL_CELLS = 1 << 24  # bound on the (context, byte) pairs of the model times its languages
_BLOCK = 1 << 20
_PARTS = 64  # parts by a hash into which counts that are alike are cut for pruning
_UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(data: np.ndarray, row_starts: np.ndarray, at: int, end: int) -> np.ndarray:
    """Each byte in [at, end) with the three before it in its row (0 before the row's first), as 32 bits."""
    rows = np.searchsorted(row_starts, np.arange(at, end), side="right") - 1
    within = np.arange(at, end) - row_starts[rows]
    out = data[at:end].astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.zeros(end - at, np.uint32)
        skip = max(0, k - at)
        before[skip:] = data[at + skip - k : end - k]
        out |= np.where(within >= k, before, 0).astype(np.uint32) << np.uint32(8 * k)
    return out


class ContextTrees:
    """Frozen trees of several languages, as tables of code lengths with one column per language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.langs = langs
        width = len(langs)
        known = np.zeros(0, np.uint32)
        self.levels = []  # by order: symbols known in some language, their costs; contexts known, their escapes
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            known, at = np.unique(gram & mask, return_inverse=True)
            counts = np.zeros((len(known), width))
            np.add.at(counts, (at, lang), count)
            contexts, of = np.unique(known >> np.uint32(8), return_inverse=True)
            total = np.zeros((len(contexts), width))
            distinct = np.zeros((len(contexts), width))
            np.add.at(total, of, counts)
            np.add.at(distinct, of, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
                own = np.log2((total + distinct)[of] / counts)
            swapped = (known & np.uint32((1 << 8 * order) - 1)) if order else known
            lower = self._below(swapped, order, width)
            self.levels.append((known, np.where(counts > 0, own, escape[of] + lower), contexts, escape))
        self.costs = self.levels[ORDER][1].astype(np.float32)
        size = 1 << max(4, int(4 * len(known)).bit_length())
        self.shift = np.uint32(32 - (size.bit_length() - 1))
        self.slots = np.full(size, -1, np.int32)
        self.size = size
        todo = np.arange(len(known), dtype=np.int32)
        slot = self._slot(known)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # one of several that want a slot stays
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (size - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def _below(self, gram: np.ndarray, order: int, width: int) -> np.ndarray:
        """Code lengths of grams (of ``order`` bytes) by the trees up to the order below."""
        if order == 0:
            return np.full((len(gram), width), 8.0)
        known, costs, contexts, escape = self.levels[order - 1]
        out = np.zeros((len(gram), width))
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        hit = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        out[hit] = costs[at[hit]]
        missed = np.flatnonzero(~hit)
        if len(missed):
            rest = gram[missed]
            context = rest >> np.uint32(8)
            place = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            out[missed] = np.where((contexts[place] == context)[:, None], escape[place], 0.0)
            out[missed] += self._below(rest & np.uint32((1 << 8 * (order - 1)) - 1), order - 1, width)
        return out

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's byte after its context, one column per language."""
        known = self.levels[ORDER][0]
        slot = self._slot(gram)
        index = self.slots[slot]
        open_ = np.flatnonzero((index >= 0) & (known[index] != gram))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.size - 1)
            index[open_] = self.slots[slot[open_]]
            open_ = open_[(index[open_] >= 0) & (known[index[open_]] != gram[open_])]
        out = self.costs[index].astype(float)
        missed = np.flatnonzero(index < 0)
        if len(missed):
            out[missed] = self._below(gram[missed], ORDER + 1, len(self.langs))
        return out

    def code_lengths(self, data: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Bits of each row under each language."""
        total = np.zeros((len(row_starts) - 1, len(self.langs)))
        for at in range(0, len(data), _BLOCK):
            end = min(len(data), at + _BLOCK)
            bits = self.lengths(grams(data, row_starts, at, end))
            rows = np.searchsorted(row_starts, np.arange(at, end), side="right") - 1
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            total[rows[first]] += np.add.reduceat(bits, first, axis=0)
        return total


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 by 4; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def context_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * _BLOCK):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                part = batch.filter(pc.equal(batch.column("lang"), lang))
                data, starts = text_bytes(part.column("text"))
                for at in range(0, len(data), 4 * _BLOCK):
                    found, n = np.unique(
                        grams(data, starts, at, min(len(data), at + 4 * _BLOCK)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64)),
                    ], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shares(sizes: dict[str, int], nodes: int) -> dict[str, int]:
    """How many counts each language keeps: all alike, and what small languages leave goes to the others; one at least."""
    out: dict[str, int] = {}
    for i, lang in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[lang] = min(sizes[lang], max(1, (nodes - sum(out.values())) // (len(sizes) - i)))
    return out


def _pruned(counts: DataFrame, cells: int) -> DataFrame:
    """The most frequent counts of every language, as many as its share; counts that are alike go by a hash of the gram.

    No task sees a whole language: counts are told apart by eighths of powers of two and hash parts, whose sizes alone are
    collected; the class in which a share ends is cut by the hash.
    """
    rank = F.floor(8 * F.log2("n")).cast("int")
    part = F.pmod(F.xxhash64("gram"), F.lit(_PARTS)).cast("int")
    classes = counts.groupBy("lang", rank.alias("rank"), part.alias("part")).count().orderBy("lang", F.desc("rank"), "part").collect()
    sizes: dict[str, int] = {}
    for row in classes:
        sizes[row["lang"]] = sizes.get(row["lang"], 0) + row["count"]
    left = shares(sizes, cells // max(1, len(sizes)))
    bounds: dict[str, tuple[int, int]] = {}  # by language the last class that is kept
    full: set[str] = set()
    for row in classes:
        lang = row["lang"]
        # the first class stays whatever its size, so that no language vanishes
        if lang not in full and (row["count"] <= left[lang] or lang not in bounds):
            left[lang] -= row["count"]
            bounds[lang] = row["rank"], row["part"]
        else:
            full.add(lang)
    if not full:
        return counts
    table = counts.sparkSession.createDataFrame([(k, *v) for k, v in bounds.items()], "lang string, last_rank int, last_part int")
    kept = (rank > F.col("last_rank")) | ((rank == F.col("last_rank")) & (part <= F.col("last_part")))
    return counts.join(F.broadcast(table), "lang").where(kept).select("lang", "gram", "n")


def learn_languages(rows: DataFrame, cells: int = MODEL_CELLS) -> ContextTrees:
    """Trees from all texts of (lang, text); if they would be too large, every language's rarest counts are pruned.

    ``cells`` bounds the (context, byte, language) counts that remain times the languages, and so the model on the
    driver and in the tasks. Each language has the same share of it and keeps its most frequent counts, so a language with few
    texts stays beside others with many; one whose counts fit its share keeps them all.
    """
    counts = materialise(context_counts(rows), "contexts")
    model = _pruned(counts, cells).toArrow()
    langs = sorted(set(model.column("lang").to_pylist()))
    codes = pc.index_in(model.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int64)
    gram = model.column("gram").to_numpy().astype(np.uint32)
    order = np.lexsort([gram, codes])
    return ContextTrees(langs, codes[order], gram[order], model.column("n").to_numpy()[order].astype(float))


def _lettered(texts: pa.Array, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = letters[starts[1:]] > letters[starts[:-1]]
    for i in np.flatnonzero(~has & (np.diff(starts) > 0)):
        has[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return has


def predict_language(
    docs: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs`` from its whole text alone.

    score is the winner's share if every language's probability of the text is weighed alike; equal codes go to the
    first language by code point. A null, empty or letterless text, or a model without languages, gives und and 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in slices(batches, "text"):
            data, starts = text_bytes(batch.column("text"))
            known = _lettered(batch.column("text"), data, starts)
            if not trees.langs:
                known[:] = False
                bits = np.zeros((batch.num_rows, 1))
            else:
                bits = trees.code_lengths(data, starts)
            best = bits.argmin(axis=1)
            gap = bits - bits.min(axis=1, keepdims=True)
            score = np.where(known, 1 / np.exp2(-gap).sum(axis=1), 0.0)
            names = [trees.langs[b] if k else _UNDETERMINED for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(score)], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cells: int = MODEL_CELLS
) -> DataFrame:
    """(id, held_out, lang_pred, score): trees learned from the rows not held out, and every row predicted.

    Rows are held out by ``held_out``; rows without a language or text teach nothing. Equal texts get equal
    results; other columns are not read; an empty table gives an empty one.
    """
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = learn_languages(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), cells)
    out = predict_language(docs, model, id_col, text_col)
    return out.withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score")
