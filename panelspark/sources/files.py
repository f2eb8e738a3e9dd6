"""Table scans: single files, file sets tagged from their paths, id lists, and the first path that exists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.names import date_column
from panelspark.functions.scalars import to_day


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, fmt: str = "csv") -> DataFrame:
    """Scan a table. CSV without a schema is read as text, one pass, to be coerced afterwards."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=False, enforceSchema=schema is not None)
    return reader.format(fmt).load(path)


def source_path() -> Column:
    return F.col("_metadata.file_path")


def from_path(path: Column, pattern: str, what: str) -> Column:
    """Group 1 of ``pattern`` in the path; an error if it is not there."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit(f"no {what} in "), path)))


def year_from_path(path: Column, pattern: str = r"ON_PM25_(\d{4})-") -> Column:
    return from_path(path, pattern, "year").cast("int")


def read_tagged(
    spark: SparkSession, paths: str | list[str], id_pattern: str = r"station_([^_/]+)_", year_pattern: str = r"_(\d{4})\.csv"
) -> DataFrame:
    """All files of a glob as one table with the station id and year taken from each path.

    Columns are matched by name: the headers are read first, files with the same one are scanned together, and a column
    that a file lacks is null there. Only files that exist are listed.
    """
    lines = spark.read.text(paths).select(source_path().alias("file"), "value", F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").withColumn("line", F.monotonically_increasing_id()).groupBy("file").agg(
        F.min_by("value", "line").alias("header"))
    kinds = first.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()  # a path per file
    if not kinds:
        raise FileNotFoundError(f"no file with a header in {paths}")
    parts = [read_table(spark, [unquote(f) for f in sorted(kind["files"])]) for kind in kinds]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_tagged(t, id_pattern, year_pattern) for t in parts])


def _tagged(table: DataFrame, id_pattern: str, year_pattern: str) -> DataFrame:
    return table.withColumns(
        {
            "station_id": from_path(source_path(), id_pattern, "station id"),
            "year": from_path(source_path(), year_pattern, "year").cast("int"),
        }
    )


def load_coverage(files: DataFrame, ids: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per year, how many of the stations have a file and how many do not.

    ``files`` and ``ids`` hold a ``station_id`` column, ``files`` also ``year``.
    """
    grid = ids.select("station_id").distinct().select(
        "station_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("year")
    )
    found = files.select("station_id", "year").distinct().withColumn("_found", F.lit(True))
    return grid.join(found, ["station_id", "year"], "left").groupBy("year").agg(
        F.count("_found").alias("n_loaded"), F.count_if(F.col("_found").isNull()).alias("n_missing")
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    ids = spark.read.text(path).select(F.trim("value").alias("station_id"))
    return ids.where("station_id <> ''")


def first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Scan of the first path that exists, with its date column as days."""
    for path in paths:
        try:
            table = read_table(spark, path, fmt=fmt)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        try:
            date = date_column(table)
        except ValueError:
            return table
        return table.withColumn(date, to_day(date))
    raise FileNotFoundError(f"none of {list(paths)} exists")
