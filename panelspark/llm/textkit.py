"""Words and word shingles of many texts at once, as arrays over the bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. The
text is handled in slices of bounded size, so that neither many rows nor one long text exhaust a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text handled at once
_BLOCK_BYTES = 1 << 17  # of these, hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = _BACK = np.zeros(0, np.uint64)  # of _STEP, as many as were needed so far
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the start of each row in them; null is empty."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``size`` bytes of text each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, starts = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _hash_block(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of one block; no word runs across a position in ``breaks``.

    A word's sum over its bytes, weighed by place, is a difference of running sums over the block, brought back to the word's first place.
    """
    global _POWERS, _BACK
    if len(data) > len(_POWERS):
        _POWERS = np.cumprod(np.full(len(data), _STEP), dtype=np.uint64)
        _BACK = np.cumprod(np.full(len(data), pow(int(_STEP), -1, 1 << 64), np.uint64), dtype=np.uint64) * _STEP
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = breaks[breaks < len(data)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last)
    sums = table[data]
    sums *= _POWERS[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    lengths = (ends - starts + 1).astype(np.uint64)
    return mix64((sums[ends] - before) * _BACK[starts] + lengths * _PLACE[0]), starts


def word_hashes(data: np.ndarray, row_starts: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word in order, and the index of each row's first word (one more at the end)."""
    table = _BYTE_LOWER if lower else _BYTE
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + min(SLICE_BYTES, _BLOCK_BYTES))
        while end < len(data) and not _SPACE[data[end]]:  # a block ends at white space or at a row's end
            step = data[end : end + _BLOCK_BYTES]
            space = np.flatnonzero(_SPACE[step])
            row = row_starts[np.searchsorted(row_starts, end)]
            end = min(int(row), end + (int(space[0]) if len(space) else len(step)))
            if row == end:
                break
        breaks = row_starts[np.searchsorted(row_starts, at) : np.searchsorted(row_starts, end)] - at
        found, where = _hash_block(data[at:end], breaks, table)
        hashes.append(found)
        starts.append(where + at)
        at = end
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return words, np.searchsorted(where, row_starts)


def word_starts(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word in order, and the index of each row's first word (one more at the end)."""
    first = ~_SPACE[data]
    inside = row_starts[row_starts < len(data)]
    begins = first[inside]
    first[1:] &= _SPACE[data[:-1]]
    first[inside] = begins
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, row_starts)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row its distinct ``width``-word shingles, sorted; a shorter row is one shingle, an empty one none."""
    total = max(0, len(words) - width + 1)
    joined = np.zeros(total, np.uint64)
    for k in range(width):
        joined += words[k : k + total] * _PLACE[k + 1]
    joined = mix64(joined + np.uint64(width))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            whole = (words[a:b] * _PLACE[1 : 1 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix64(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
