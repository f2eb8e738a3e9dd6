"""Bounded filling of gaps in an entity's series. Filled values between two readings look ahead to the second.

Series are worked on in blocks of days; a gap may span any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.segments import BLOCK_DAYS, surrounding


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.fillna(0, subset=present) if present else df


def interpolate_forward(
    df: DataFrame, entity: str, date: str, limits: dict[str, int], block_days: int = BLOCK_DAYS
) -> DataFrame:
    """Linear interpolation by row position of the first ``limit`` nulls of each gap.

    Nulls before the first reading stay; after the last reading it is repeated, up to ``limit`` times.
    """
    cols = [c for c in limits if c in df.columns]
    around = surrounding(df, entity, date, cols, ahead=True, block_days=block_days)
    filled = {}
    for c in cols:
        last, nxt = F.col(f"_last_{c}"), F.col(f"_next_{c}")
        step = F.col("_rn") - last["at"]
        slope = F.try_divide(nxt["v"] - last["v"], nxt["at"] - last["at"])
        line = F.when(nxt.isNull(), last["v"]).otherwise(last["v"] + slope * step)
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(step <= limits[c], line)
    return around.withColumns(filled).select(*df.columns)


def ffill(
    df: DataFrame, entity: str, date: str, limits: dict[str, int], block_days: int = BLOCK_DAYS
) -> DataFrame:
    """Repeat the last reading, up to ``limit`` times per gap."""
    cols = [c for c in limits if c in df.columns]
    around = surrounding(df, entity, date, cols, ahead=False, block_days=block_days)
    filled = {
        c: F.when(F.col("_rn") - F.col(f"_last_{c}")["at"] <= limits[c], F.col(f"_last_{c}")["v"]) for c in cols
    }
    return around.withColumns(filled).select(*df.columns)
