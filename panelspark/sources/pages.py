"""Ids found in web pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The query parameter that carries a station id, and the names of the input field that does.
ID_PARAMETER = r"StationID=(\d+)"
ID_LINK = r"""<a\b[^>]*?href\s*=\s*["'][^"']*?[?&]StationID=(\d+)"""
ID_INPUT = r"""name\s*=\s*["'](StationID|stationID|stationId)["']"""


def input_values(html: str, name_pattern: str = ID_INPUT) -> Column:
    """Trimmed values of the input fields whose name fits."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<input\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda tag: tag.rlike(name_pattern))
    return F.transform(named, lambda tag: F.trim(F.regexp_extract(tag, r"""(?is)\bvalue\s*=\s*["']([^"']*)["']""", 1)))


def extract_ids(pages: DataFrame, patterns: Mapping[str, Sequence[str]], inputs: Sequence[str] = ()) -> DataFrame:
    """Distinct numeric ids, by number: group 1 of every pattern match per column, and input values."""
    lists = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for c, ps in patterns.items() for p in ps]
    lists += [input_values(c) for c in inputs]
    found = reduce(F.array_union, lists)
    ids = pages.select(F.explode(found).alias("station_id")).where(F.col("station_id").rlike(r"^\d+$"))
    return ids.distinct().orderBy(F.col("station_id").cast("decimal(38,0)"))


def station_ids(pages: DataFrame, html: str = "html") -> DataFrame:
    return extract_ids(pages, {html: [ID_LINK, ID_PARAMETER]}, inputs=[html])


def page_links(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Every link target of every page."""
    links = F.regexp_extract_all(html, F.lit(r"""<a\b[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(page, F.explode(links).alias("href"))
