"""Incremental form of the stateless cleaning step.

Daily files keep arriving; each run picks up the files not seen before, cleans their rows with the same
expressions as the batch plan and appends them. What needs a whole key or series (de-duplication, windows)
stays in the batch plans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelspark.operators.clean import clean_rows


def append_new_weather(
    spark: SparkSession, path: str, schema: T.StructType, out: str, progress: str
) -> StreamingQuery:
    """Clean all weather files that arrived since the last run and append them to ``out``."""
    raw = spark.readStream.schema(schema).option("header", True).csv(path)
    return (
        clean_rows(raw).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
