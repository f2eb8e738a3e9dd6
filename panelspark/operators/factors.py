"""Triangular factors of feature rows, which keep all digits that a linear fit needs.

Each task reduces its rows to one factor R per group, with R'R the products of (1, *cols); factors of a group are
stacked and reduced again, first within 64 parts of it and then in one place, where a factor at a time arrives. Unlike sums of
products, a factor does not square the data: columns far from 0 and nearly dependent ones keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HELD = 64  # factors a task keeps before it hands them on
_PARTS = 64


def reduced(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of a matrix; at most as many rows as columns."""
    return np.linalg.qr(rows, mode="r")


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, r array<double>"


def factor_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, n, r) per group: its number of rows and the factor of (1, *cols), row by row.

    ``cols`` must hold no nulls; rows with a null key are left out.
    """
    keys, cols = list(keys), list(cols)
    width = len(cols) + 1

    def rows_of(held: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=keys)
        return out.assign(n=[n for n, _ in held.values()], r=[r.ravel() for _, r in held.values()])

    def take(held: dict, key: tuple, n: int, block: np.ndarray) -> None:
        count, factor = held.pop(key, (0, block[:0]))  # the key seen last goes to the end
        held[key] = (count + n, reduced(np.vstack([factor, block])))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                block = np.ones((len(group), width))
                block[:, 1:] = group[cols].to_numpy(dtype="float64")
                take(held, key, len(group), block)
            if len(held) > MAX_HELD:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}  # rows come sorted by key, so only the last key can have more
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                for n, r in zip(group["n"], group["r"]):
                    take(held, key, n, np.reshape(r, (-1, width)))
            if len(held) > MAX_HELD:
                last = list(held)[-1]
                rest = {last: held.pop(last)}
                yield rows_of(held)
                held = rest
        if held:
            yield rows_of(held)

    schema = _typed(df, keys)
    factors = df.dropna(subset=keys).select(*keys, *cols).mapInPandas(first, schema)
    for parted in ([F.pmod(F.xxhash64("r"), F.lit(_PARTS))], []):
        factors = factors.repartition(*keys, *parted).sortWithinPartitions(*keys).mapInPandas(merge, schema)
    return factors


def as_factor(r: Sequence[float], width: int) -> np.ndarray:
    """Factor of one group from its row."""
    return np.reshape(np.asarray(r, dtype="float64"), (-1, width))
