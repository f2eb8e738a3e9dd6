"""Block reports: text files that alternate free-text preambles with blocks of hourly data lines.

Files are read line by line and in splits. What a line means depends on the lines before it, so each split
is scanned on its own and what it starts with is carried over from the splits before it, one row per split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.scalars import to_day, to_number
from panelspark.operators.aggregates import HOURS
from panelspark.session import materialise
from panelspark.sources.files import source_path, year_from_path

# How a block starts, how a data line starts, the missing-hour code, the columns of a block.
BLOCK_HEADER = "Station ID,Pollutant,Date"
DATA_LINE = r"^\d{3,},"
MISSING_HOUR = 9999
REPORT_COLUMNS = ["Station ID", "Pollutant", "Date", *HOURS]

# Where a preamble names the station and its coordinates.
STATION_PATTERN = (
    r"(?is)Station,\s*([^,]*?)\s*\((\d+)\).*?Latitude,\s*([-\d.]+)\s*Longitude,\s*([-\d.]+)"
)


def report_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file, split and order within the split."""
    return spark.read.text(path).select(
        source_path().alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def _is_header() -> Column:
    return F.col("value").startswith(BLOCK_HEADER)


def _is_data() -> Column:
    return F.col("value").rlike(DATA_LINE)


def _arriving(lines: DataFrame, marker: Column, fold, carry) -> DataFrame:
    """(file, split, _in): what the markers of the splits before each split of a file fold to, one row per split."""
    others = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    per_split = lines.withColumn("_marker", marker).groupBy("file", "split").agg(carry.alias("_out"))
    return per_split.withColumn("_in", fold(F.col("_out")).over(others)).drop("_out")


def _places(names: Column, wanted: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in wanted]), lambda c: F.array_position(names, c).cast("int"))


def _with_headers(lines: DataFrame, heads: Sequence[str], hours: Sequence[str]) -> DataFrame:
    """Data lines as (file, split, value, heads, hours): where their block's header has the wanted columns.

    Both are empty after a closed block, and null before the first marker of a split. A scan hands a split's lines on in
    order, so the state runs along with the lines and nothing is shuffled.
    """

    def places(header: str) -> tuple[list[int], list[int]]:
        names = [n for n in (part.strip(" ") for part in header.split(",")) if n]
        return tuple([names.index(c) + 1 if c in names else 0 for c in wanted] for wanted in (heads, hours))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, (None, None)
        for batch in batches:
            rows: list[tuple] = []
            for i, (file, split, kind, value) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if here != (file, split):
                    here, state = (file, split), (None, None)
                if kind == "data":
                    rows.append((i, *state))
                else:
                    state = places(value) if kind == "header" else ([], [])
            kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("file"), kept.column("split"), kept.column("value"),
                 *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]],
                ["file", "split", "value", "heads", "hours"])

    kind = F.when(_is_header(), "header").when(_is_data(), "data").otherwise("end")
    marked = lines.where(F.trim("value") != "").select("file", "split", kind.alias("kind"), "value")
    return marked.mapInArrow(run, "file string, split long, value string, heads array<int>, hours array<int>")


def read_block_report(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] = REPORT_COLUMNS
) -> DataFrame:
    """The data lines of all blocks, columns by the names in their block's header.

    A block runs from its header to the next line that is neither data nor blank, or to the end of the file; rows directly
    followed by a further header count. Lines are not shuffled: only one row per split, its last marker, is.
    """
    lines = report_lines(spark, path)
    hours = [c for c in columns if c in HOURS]
    heads = [c for c in columns if c not in HOURS]
    closes = ~_is_data() & (F.trim("value") != "")
    marker = F.when(_is_header(), F.col("value")).when(closes, F.lit(""))
    last = F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.col("line")))
    before = materialise(_arriving(lines, marker, lambda m: F.last(m, ignorenulls=True), last), "splits")
    names = F.filter(F.transform(F.split("_in", ","), lambda n: F.trim(n)), lambda n: n != "")
    rows = _with_headers(lines, heads, hours).join(before, ["file", "split"], "left").select(
        "file", *[F.coalesce(c, F.when(F.col("_in") != "", _places(names, wanted))).alias(f"_{c}")
                  for c, wanted in (("heads", heads), ("hours", hours))],
        F.split(F.regexp_replace(F.rtrim("value"), ",+$", ""), ",").alias("_cells"),
    ).where("size(_heads) + size(_hours) > 0")

    def text(place: Column) -> Column:
        return F.trim(F.try_element_at(F.col("_cells"), F.nullif(place, F.lit(0))))

    numbers = F.transform(F.col("_hours"), lambda p: to_number(text(p)))
    read = rows.select(
        "file", F.transform(F.col("_heads"), text).alias("_texts"),
        F.transform(numbers, lambda n: F.when(n != MISSING_HOUR, n)).alias("_numbers"),
    )

    def typed(name: str) -> Column:
        if name in hours:
            return F.expr(f"_numbers[{hours.index(name)}] as {name}")
        found = F.nullif(F.col("_texts")[heads.index(name)], F.lit(""))
        if name == "Date":
            found = to_day(found)
        elif name == "Station ID":
            found = to_number(found).cast("long")
        return found.alias(name)

    return read.select(*[typed(c) for c in columns], year_from_path(F.col("file")).alias("year"))


def report_preambles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, text): the lines before each block of a file that name a station or its place.

    All other lines go before anything is shuffled, so a group holds what its preamble says of stations and no more.
    """
    named = F.col("value").rlike(r"(?i)Station,|Latitude,|Longitude,|\(\d+\)")
    lines = report_lines(spark, path).where(_is_header() | (named & ~_is_data()))
    marker = F.when(_is_header(), 1).otherwise(0)
    before = _arriving(lines, marker, lambda m: F.sum(m), F.sum("_marker"))
    in_split = W.partitionBy("file", "split").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = lines.withColumn("_here", F.sum(marker).over(in_split)).join(before, ["file", "split"])
    block = F.col("_here") + F.coalesce(F.col("_in"), F.lit(0))
    free = numbered.where(~_is_header()).select("file", block.alias("block"), "split", "line", "value")
    spot = F.struct("split", "line", "value")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda s: s["value"]), "\n")
    return free.groupBy("file", "block").agg(text.alias("text"))


def extract_station_meta(texts: DataFrame, text: str = "text") -> DataFrame:
    """Id, name and coordinates for every station named in each text, with the other columns and the place in the text."""
    groups = [F.regexp_extract_all(text, F.lit(STATION_PATTERN), F.lit(g)) for g in (1, 2, 3, 4)]
    rest = [c for c in texts.columns if c != text]
    found = texts.select(
        *rest, F.posexplode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])).alias("place", "m"))
    return found.select(
        F.col("m.g2").cast("long").alias("station_id"), F.trim("m.g1").alias("station_name"),
        to_number("m.g3").alias("latitude"), to_number("m.g4").alias("longitude"), *rest, "place",
    )
