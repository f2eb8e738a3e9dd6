"""Schema reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def schema_report(df: DataFrame, order: Sequence[Column | str] = (), preview: int = 3) -> DataFrame:
    """Position, name and type of each column, with its values in the first rows."""
    head = (df.orderBy(*order) if order else df).limit(preview).collect()
    rows = [
        (i, f.name, f.dataType.simpleString(), " | ".join(str(r[f.name]) for r in head))
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string, preview string")
