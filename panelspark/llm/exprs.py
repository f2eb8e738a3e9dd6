"""Column helpers for whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"  # between words
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body's lambdas mention it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """Number of code points of ``text`` that are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")
