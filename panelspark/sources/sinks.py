"""Writers: tables, compressed tables, metrics, and sequence datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", codec: str | None = None,
    partition_by: Sequence[str] = (), mode: str = "errorifexists",
) -> None:
    """Write without an index; folders are made as needed. ``codec`` compresses, also CSV."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if codec:
        writer = writer.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_sequences(df: DataFrame, path: str, features: Sequence[str], col: str = "x") -> None:
    """Sequences as Parquet; the feature names travel in the metadata of the matrix column."""
    named = df.withColumn(col, F.col(col).alias(col, metadata={"features": list(features)}))
    named.write.parquet(path)


def read_sequences(spark: SparkSession, path: str, col: str = "x") -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    return df, df.schema[col].metadata.get("features", [])
