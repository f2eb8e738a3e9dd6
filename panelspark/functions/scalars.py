"""Column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(value: Column | str) -> Column:
    """Number, or null for anything that is not one (NaN included)."""
    return F.nanvl(as_col(value).try_cast("double"), F.lit(None).cast("double"))


def to_day(value: Column | str) -> Column:
    """Day of a date, timestamp or text; null if it cannot be read."""
    return as_col(value).try_cast("timestamp_ntz").cast("date")


def to_month(value: Column | str) -> Column:
    return F.trunc(as_col(value), "MM")


def day_diff(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


def date_parts(value: Column | str) -> dict[str, Column]:
    day = as_col(value)
    return {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "day_of_year": F.dayofyear(day)}


def cyclic_doy(value: Column | str) -> tuple[Column, Column]:
    """Sine and cosine of the day of year on a 365-day circle."""
    angle = F.dayofyear(as_col(value)) * F.lit(2.0) * F.pi() / F.lit(365.0)
    return F.sin(angle), F.cos(angle)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1) / 2)
    half_lon = F.sin((lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def log1p_target(value: Column | str) -> Column:
    return F.log1p(F.greatest(as_col(value), F.lit(0.0)))


def inverse_target(value: Column | str, logged: bool = True) -> Column:
    back = F.expm1(as_col(value)) if logged else as_col(value)
    return F.greatest(back, F.lit(0.0))


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(as_col(value), F.lit(low)), F.lit(high))


def direction_degrees(tens: Column | str) -> Column:
    """Tens of degrees to degrees in [0, 360)."""
    return F.pmod(as_col(tens) * F.lit(10.0), F.lit(360.0))


def has_mark(value: Column | str) -> Column:
    return as_col(value).isNotNull().cast("byte")


def normalise_id(value: Column | str) -> Column:
    """Id text without blanks around it and without a trailing ``.0``."""
    return F.regexp_replace(F.trim(as_col(value).cast("string")), r"\.0$", "")


def composite_label(name: Column | str, key: Column | str) -> Column:
    return F.concat(F.coalesce(as_col(name), F.lit("Unknown")), F.lit(" ("), as_col(key).cast("string"), F.lit(")"))


def synthetic_id(lat: Column | str, lon: Column | str, digits: int = 5) -> Column:
    return F.concat(
        F.lit("lat"), F.round(as_col(lat), digits).cast("string"),
        F.lit("_lon"), F.round(as_col(lon), digits).cast("string"),
    )


def quoted(name: str) -> str:
    """Column name for use in an SQL expression, which builds a wide expression in one call to the JVM."""
    return "`" + name.replace("`", "``") + "`"


def valid_count(cols: Sequence[str]) -> Column:
    """How many of the columns hold a value."""
    return F.expr(" + ".join(f"int({quoted(c)} is not null)" for c in cols))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over the columns that hold a value; null if none does."""
    total = " + ".join(f"coalesce({quoted(c)}, 0D)" for c in cols)
    return F.try_divide(F.expr(total), valid_count(cols))


def apply_min_hours(mean: Column, hours: Column, min_hours: int) -> Column:
    return F.when(hours >= F.lit(max(min_hours, 1)), mean)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation over rows that hold both, null where either does not vary."""
    x, y = as_col(x), as_col(y)
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def null_safe(left: DataFrame, key: Sequence[str], right: DataFrame) -> Column:
    """Equality of the key with the columns ``_k0, _k1, ..`` of ``right`` that also matches nulls."""
    return functools.reduce(operator.and_, [left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(key)])
