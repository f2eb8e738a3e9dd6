"""Column names: normalisation, roles and selections. Driver-side work on ``df.columns`` only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names under which a date column is known, in order of preference.
DATE_NAMES = ["DATE", "Date", "date", "DATE_LOCAL", "date_local", "DATE_PST", "DATE_EST", "DATE_UTC"]

# Names under which a station id is known when no name holds both "station" and "id".
STATION_NAMES = ["station_id", "stationId", "station", "station_name", "climate_id", "climateId", "wmo", "wmo_id", "id"]

# Feature names that stand for a region code.
REGION_NAMES = ["region", "region_id", "region_code", "region_idx", "area", "area_id", "zone", "zone_id"]

HOUR_NAME = re.compile(r"H\d{2}")


def snake_name(name: str) -> str:
    spelled = name.strip().translate({ord("°"): "deg", ord("/"): "_", ord("("): None, ord(")"): None})
    return "_".join(re.findall(r"[0-9A-Za-z]+", spelled)).lower()


def snake_case(df: DataFrame) -> DataFrame:
    """Snake-case every column name; of columns that end up with one name the last is kept."""
    return dedupe_columns(df.toDF(*[snake_name(c) for c in df.columns]))


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the last column of each name."""
    names = df.columns
    if len(set(names)) == len(names):
        return df
    last = {name: position for position, name in enumerate(names)}
    slots = [f"slot_{position}" for position in range(len(names))]
    kept = sorted(last.items(), key=lambda item: item[1])
    unique = df.toDF(*slots)
    return unique.select(*[unique[slots[position]].alias(name) for name, position in kept])


def normalise_headers(df: DataFrame, lower: bool = True) -> DataFrame:
    names = [c.strip() for c in df.columns]
    return df.toDF(*[n.lower() for n in names] if lower else names)


def _plain(name: str) -> str:
    return re.sub(r"[\s_]+", "", name).lower()


def resolve(columns: Iterable[str], rules: Iterable[Callable[[str], bool]]) -> str | None:
    """The first column, in table order, that meets the earliest rule any column meets."""
    columns = list(columns)
    return next((c for rule in rules for c in columns if rule(c)), None)


def _same_as(names: Iterable[str], spelled: Callable[[str], str] = str) -> list[Callable[[str], bool]]:
    return [lambda column, name=name: spelled(column) == spelled(name) for name in names]


def pick_col(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """First candidate present, ignoring case, blanks and underscores."""
    found = resolve(df.columns, _same_as(candidates, _plain))
    if found is None and required:
        raise ValueError(f"none of {list(candidates)} among columns {df.columns}")
    return found


def date_column(df: DataFrame) -> str:
    """A known date name, else any spelling of "date"."""
    found = resolve(df.columns, [*_same_as(DATE_NAMES), lambda c: c.strip().lower() == "date"])
    if found is None:
        raise ValueError(f"no date column among {df.columns}")
    return found


def station_column(df: DataFrame) -> str | None:
    """A name holding both "station" and "id" wins; otherwise a known station name; otherwise none."""
    return resolve(df.columns, [lambda c: "station" in c.lower() and "id" in c.lower(), *_same_as(STATION_NAMES)])


def hour_columns(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if HOUR_NAME.fullmatch(c)), key=lambda c: int(c[1:]))


def region_feature(names: Iterable[str]) -> str | None:
    return resolve(names, _same_as(REGION_NAMES, str.lower))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = (), exclude_containing: str | None = None) -> list[str]:
    dropped = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in dropped
        and not (exclude_containing and exclude_containing in f.name.lower())
    ]


def drop_matching(
    df: DataFrame, suffix: str | None = None, contains: Sequence[str] = (), names: Sequence[str] = ()
) -> DataFrame:
    """Drop columns by name ending, by part of the name, or by name."""
    gone = [
        c
        for c in df.columns
        if (suffix and c.endswith(suffix)) or any(part in c for part in contains) or c in names
    ]
    return df.drop(*gone)


def reorder(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """``first`` (where present), then all other columns, then ``last``."""
    names = df.columns
    head = [c for c in first if c in names]
    ends = set(head) | set(last)
    return df.select(*head, *[c for c in names if c not in ends], *last)


def rename_roles(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    names = df.columns
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in names})


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    present = df.columns
    missing = [n for n in names if n not in present]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
