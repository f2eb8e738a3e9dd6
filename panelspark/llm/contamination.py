"""Benchmark passages in documents, exact or edited, by the q-gram lemma.

Texts are reduced to lower-case words with single spaces. Benchmark items are cut into overlapping segments. A
document region within ``k`` edits of a segment of n bytes shares at least n - q + 1 - k * q of its q-grams with
it, all on diagonals that differ by at most k; so hits are counted in overlapping diagonal bands, bands below
that bound are dropped, and the rest are verified by a banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textkit import mix64, slices, text_bytes

GRAM = 7  # bytes of a q-gram
SEGMENT = 64  # bytes of a segment of an item; segments start every half of that
EDIT_RATE = 0.11  # edits allowed per byte of a segment, a replaced word of up to 7 letters in a whole one
LEAST = 12  # items of fewer bytes, such as one word, never match; the shortest others match exactly only
BLOCK_BYTES = 4 << 20  # text of benchmark items that is sent to the workers at once
PIECE_CHARS = 1 << 16  # longer items are cut into overlapping pieces before they are dealt to blocks
_SLICE = 1 << 20
_FILTER_BITS = 22
_SLOTS = (1 << 20) - 1
_ALIGNED = 2048  # candidate regions aligned together

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[b for b in range(128) if not chr(b).isalnum()]] = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def reduced(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with one space after each, where rows start in them, and each byte's place in ``data``."""
    classes = _CLASS[data]
    kept = classes != 32
    after = np.zeros(len(data), bool)
    after[1:] = kept[:-1]
    rows = starts[(starts > 0) & (starts < len(data))]
    after[rows] = False
    places = np.flatnonzero(kept | after)
    return classes[places], np.searchsorted(places, starts), places


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, without the last places."""
    width, power = 1, _BASE
    level, levels = data.astype(np.uint64) + np.uint64(1), []
    while width <= GRAM:
        levels.append((width, level))
        level = level[: len(level) - width] * power + level[width:] if len(level) > width else level[:0]
        width, power = 2 * width, np.uint64(int(power) ** 2 % 2**64)
    size = max(0, len(data) - GRAM + 1)
    out, at = np.zeros(size, np.uint64), 0
    for width, level in reversed(levels):
        if at + width <= GRAM:
            shift = np.uint64(pow(int(_BASE), width, 2**64))
            out = out * shift + level[at : at + size]
            at += width
    return mix64(out)


class SegmentIndex:
    """q-grams of the segments of some items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, self.lengths, self.edits, texts, grams, owner, place = [], [], [], [], [], [], []
        for item, text in items:
            raw, starts = text_bytes(pa.array([text], pa.string()))
            whole = reduced(raw, starts)[0]
            if len(whole) and whole[-1] == 32:
                whole = whole[:-1]
            if len(whole) < LEAST:
                continue
            last = max(0, len(whole) - SEGMENT)
            for at in sorted({*range(0, last, SEGMENT // 2), last}):
                part = whole[at : at + SEGMENT]
                hashes = gram_hashes(part)
                owner.append(np.full(len(hashes), len(self.items)))
                place.append(np.arange(len(hashes)))
                grams.append(hashes)
                self.items.append(item)
                self.lengths.append(len(part))
                self.edits.append(min(int(EDIT_RATE * len(part)), (len(part) - GRAM) // GRAM))
                texts.append(np.pad(part, (0, SEGMENT - len(part))))
        self.lengths, self.edits = np.array(self.lengths, np.int64), np.array(self.edits, np.int64)
        self.texts = np.array(texts, np.uint8).reshape(-1, SEGMENT)
        found = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.grams, first = np.unique(found[order], return_index=True)
        self.first = np.append(first, len(found))
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.needs = self.lengths - GRAM + 1 - self.edits * GRAM  # hits, by the lemma
        # hits that a segment with the gram needs at least: short items don't lower it for the grams of others
        self.gram_needs = np.minimum.reduceat(self.needs[self.owner], first) if len(first) else first
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _FILTER_BITS)] = True

    def regions(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(row, segment, band) of every band whose hits reach the lemma's bound."""
        hashes = gram_hashes(data)
        spots = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.grams, hashes[spots])
        hit = at < len(self.grams)
        hit[hit] = self.grams[at[hit]] == hashes[spots[hit]]
        spots, at = spots[hit], at[hit]
        row = np.searchsorted(rows, spots, side="right") - 1
        inside = spots + GRAM <= rows[row + 1]
        spots, at, row = spots[inside], at[inside], row[inside]
        # the hits of a band lie within a segment and the edits of it; a gram with fewer around than it needs is dropped
        reach = SEGMENT + 2 * int(self.edits.max(initial=0)) + 2
        near = np.searchsorted(spots, spots + reach) - np.searchsorted(spots, spots - reach)
        dense = near >= self.gram_needs[at]
        spots, at, row = spots[dense], at[dense], row[dense]
        if len(spots) == 0:
            return np.zeros((0, 3), np.int64)
        n = self.first[at + 1] - self.first[at]
        posting = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        segment = self.owner[posting]
        alike = self.lengths.min() == self.lengths.max()  # one step and one need then, not one per hit
        step = int(self.edits[0]) + 1 if alike else self.edits[segment] + 1
        band = (np.repeat(spots - rows[row] + SEGMENT, n) - self.place[posting]) // step
        row = np.repeat(row, n)
        wide = int(band.max()) + 2  # one number per (row, segment, band), as these sort faster
        packed = (row * len(self.lengths) + segment) * wide + band + 1
        # a count per slot, which several bands may share, rules most hits out before the sort
        slot = packed & _SLOTS
        held = np.bincount(slot, minlength=_SLOTS + 1).astype(np.int32)
        most = held + np.maximum(np.roll(held, 1), np.roll(held, -1))
        packed = packed[most[slot] >= (self.needs[0] if alike else self.needs[segment])]
        packed, counts = np.unique(np.concatenate([packed, packed - 1]), return_counts=True)
        enough = counts >= self.needs[packed // wide % len(self.lengths)]
        owner, band = np.divmod(packed[enough], wide)
        return np.stack([*np.divmod(owner, len(self.lengths)), band - 1], 1)

    def aligned(self, data: np.ndarray, rows: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per region the least number of edits in its band, and where in ``data`` such an alignment ends.

        A region that cannot stay within its segment's edits any more is given up and has SEGMENT edits.
        """
        best, ends = [], []
        for i in range(0, len(regions), _ALIGNED):
            b, e = self._align(data, rows, regions[i : i + _ALIGNED])
            best.append(b)
            ends.append(e)
        return (np.concatenate(best), np.concatenate(ends)) if best else (np.zeros(0, int), np.zeros(0, int))

    def _align(self, data: np.ndarray, rows: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, segment, band = regions.T
        edits = self.edits[segment]
        low = rows[row] + band * (edits + 1) - SEGMENT - edits  # first diagonal, as a place in data
        width = 4 * int(edits.max()) + 3
        diagonals = np.arange(width)
        begin, end = rows[row][:, None], rows[row + 1][:, None]
        outside = np.where((low[:, None] + diagonals >= begin) & (low[:, None] + diagonals <= end), 0, SEGMENT)
        costs = np.minimum.accumulate(outside - diagonals, axis=1) + diagonals
        best = np.full(len(regions), SEGMENT)
        ends = np.zeros(len(regions), np.int64)
        held = np.arange(len(regions))
        for j in range(int(self.lengths[segment].max())):
            if j % 8 == 7:
                alive = costs.min(axis=1) <= edits
                held, costs, begin, end = held[alive], costs[alive], begin[alive], end[alive]
                low, edits, segment = low[alive], edits[alive], segment[alive]
            place = low[:, None] + j + diagonals
            valid = (place >= begin) & (place < end)
            letter = np.where(valid, data[np.where(valid, place, 0)], 255)
            moved = costs + (letter != self.texts[segment, j][:, None]) + np.where(valid, 0, SEGMENT)
            moved[:, :-1] = np.minimum(moved[:, :-1], costs[:, 1:] + 1)  # a byte of the segment is missing
            costs = np.minimum.accumulate(moved - diagonals, axis=1) + diagonals  # further bytes in the document
            done = np.flatnonzero(self.lengths[segment] == j + 1)
            if len(done):
                at = costs[done].argmin(axis=1)
                best[held[done]] = costs[done, at]
                ends[held[done]] = low[done] + j + 1 + at
        return best, ends

    def search(self, texts: pa.Array) -> list[tuple[int, object, int, int, int]]:
        """(row, item, edits, start, end) of every matching region; places are bytes of the row's text."""
        raw, starts = text_bytes(texts)
        data, rows, places = reduced(raw, starts)
        regions = self.regions(data, rows)
        edits, ends = self.aligned(data, rows, regions)
        close = edits <= self.edits[regions[:, 1]]
        out = []
        for (row, segment, _), cost, end in zip(regions[close], edits[close], ends[close]):
            last = min(int(end), int(rows[row + 1])) - 1
            first = max(int(rows[row]), last + 1 - int(self.lengths[segment]))
            out.append((int(row), self.items[segment], int(cost), int(places[first] - starts[row]),
                        int(places[last] - starts[row]) + 1))
        return out


def benchmark_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_BYTES, each of which is collected on its own."""
    step = PIECE_CHARS - 2 * SEGMENT
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 2 * SEGMENT, F.lit(0)), F.lit(step)))
    pieces = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").select(
        "item", "text", piece.alias("at")).select("item", F.substring("text", F.col("at") + 1, PIECE_CHARS).alias("text"))
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for i in range(blocks):
        yield [(r["item"], r["text"]) for r in pieces.where(block == i).orderBy("item", "text").collect()]


def benchmark_matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item, n_regions, edits, start, end): documents that hold a passage of a benchmark item.

    One row per row of ``docs`` and item: the number of matching segment regions, the fewest edits of one, and the
    range of bytes that they span in the text. Null and empty texts, and items under LEAST bytes, match nothing;
    equal rows give equal results, and items with equal texts all match; a null id stays null; other columns are
    not read. Each block of items is one pass over ``docs``.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, items.schema[item_col].dataType),
        T.StructField("n_regions", T.LongType()), T.StructField("edits", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    passes = [_matches(rows, block, schema) for block in benchmark_blocks(items, item_col, item_text) if block]
    for more in passes:
        out = out.union(more) if len(passes) > 1 else more
    if len(passes) < 2:
        return out
    # an item cut into pieces can match in several passes; rows of equal ids and texts then count together
    return out.groupBy(id_col, item_col).agg(
        F.sum("n_regions").alias("n_regions"), F.min("edits").alias("edits"), F.min("start").alias("start"),
        F.max("end").alias("end"))


def _matches(rows: DataFrame, block: list[tuple[object, str]], schema: T.StructType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        index, types = SegmentIndex(shared.value), to_arrow_schema(schema)
        for batch in slices(batches, "text", _SLICE):
            found: dict[tuple, list[int]] = {}
            for row, item, edits, start, end in index.search(batch.column("text")):
                seen = found.setdefault((row, item), [0, edits, start, end])
                found[row, item] = [seen[0] + 1, min(seen[1], edits), min(seen[2], start), max(seen[3], end)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array([k[0] for k in found], pa.int64())),
                pa.array([k[1] for k in found], types[1].type),
                *[pa.array([v[i] for v in found.values()], pa.int64()) for i in range(4)],
            ], schema=types)

    return rows.mapInArrow(run, schema)


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    for block in benchmark_blocks(items, item_col, item_text):
        docs = _without(docs, text_col, block) if block else docs
    return docs


def _without(docs: DataFrame, text_col: str, block: list[tuple[object, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(shared.value)
        for batch in slices(batches, text_col, _SLICE):
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in index.search(batch.column(text_col))]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
