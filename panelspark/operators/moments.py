"""Cross-product moments of feature rows, the only thing a linear fit needs of its data.

Each task folds its rows into one matrix per group as they stream by; the matrices are then added up. Rows
of one group that sit in several tasks give several matrices, so a large group is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HELD = 64  # matrices a task keeps before it hands them on

def moment_rows(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per group, the matrix of sums of products of (1, *cols), one row per matrix row.

    ``cols`` must hold no nulls. Matrix entry (0, 0) is the number of rows.
    """
    keys, cols = list(keys), list(cols)
    width = len(cols) + 1

    def rows_of(held: dict) -> pd.DataFrame:
        out = pd.DataFrame([key for key in held for _ in range(width)], columns=keys)
        return out.assign(i=list(range(width)) * len(held), s=[row for m in held.values() for row in m])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                values = np.ones((len(group), width))
                values[:, 1:] = group[cols].to_numpy(dtype="float64")
                held[key] = held.get(key, 0) + values.T @ values
            if len(held) > MAX_HELD:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)

    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    partial = df.select(*keys, *cols).mapInPandas(fold, f"{key_types}, i int, s array<double>")
    added = partial.groupBy(*keys, "i").agg(
        F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s")
    )
    return added


def as_matrix(rows: pd.DataFrame) -> np.ndarray:
    """Matrix of one group from its rows."""
    return np.array(rows.sort_values("i")["s"].tolist())
