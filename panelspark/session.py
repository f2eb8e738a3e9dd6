"""Session helpers: where shared intermediate tables live and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse, unless the session has executors elsewhere and the warehouse is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        if spark.conf.get("spark.sql.warehouse.dir").startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/") if root else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/panelspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Call it once the results that need them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Hash-partition on the keys into a fixed number of partitions.

    For few rows that cost much work each: left to itself, Spark would merge them into one task by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialise(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later jobs see the same rows even if an executor is lost, and scans of the copy are
    still pruned to the columns they need. With ``release`` the shuffle files of the write are deleted
    as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    if release:
        spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
