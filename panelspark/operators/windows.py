"""Features over an entity's days: labels, lags, rolling statistics, sequences, splits.

A window holds one entity's series. (entity, day) is unique in a panel, so a series is never longer than
the calendar, however skewed the readings behind it were; ``checked_days`` makes a table that breaks this
fail inside the same window pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.scalars import cyclic_doy, quoted
from panelspark.operators.ordering import before_rank, day_counts
from panelspark.session import materialise


def series(entity: str, date: str):
    return W.partitionBy(entity).orderBy(date)


def checked_days(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Rows with an entity and a day, failing if an entity has a day twice."""
    present = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).withColumn(date, F.col(date).cast("date"))
    before = present.withColumn("_before", F.lag(date).over(series(entity, date)))
    repeated = F.when(F.col("_before") == F.col(date), F.raise_error(F.lit("duplicate entity and day")))
    return before.where(repeated.cast("int").isNull()).drop("_before")


def next_label(df: DataFrame, entity: str, date: str, value: str, name: str = "label") -> DataFrame:
    """Value of the entity's next row; rows without one are left out."""
    w = series(entity, date)
    return checked_days(df, entity, date).withColumn(name, F.lead(value).over(w)).dropna(subset=[name])


def _over(entity: str, date: str, rows: str = "", days: str = "") -> str:
    """A window clause by rows, or by days where ``days`` is given."""
    order = f"unix_date({quoted(date)}) range {days}" if days else f"{quoted(date)} {rows}"
    return f"over (partition by {quoted(entity)} order by {order})"


def lag_columns(entity: str, date: str, lags: Mapping[str, Sequence[int]], calendar: bool = False) -> dict[str, Column]:
    """The value ``k`` rows earlier, or ``k`` days earlier with ``calendar``: null where that day has no row."""
    if calendar:
        return {f"{c}_lag_{k}": F.expr(f"first({quoted(c)}) {_over(entity, date, days=f'between {k} preceding and {k} preceding')}")
                for c, ks in lags.items() for k in ks}
    return {f"{c}_lag_{k}": F.expr(f"lag({quoted(c)}, {k}) {_over(entity, date)}") for c, ks in lags.items() for k in ks}


def rolling_columns(
    entity: str, date: str, windows: Mapping[str, Sequence[int]], calendar: bool = False
) -> dict[str, Column]:
    """Mean and sample deviation over the last ``n`` rows (days with ``calendar``), this one included, where all hold a
    value."""
    out = {}
    for c, sizes in windows.items():
        for n in sizes:
            frame = _over(entity, date, f"rows {n - 1} preceding", f"{n - 1} preceding" if calendar else "")
            for name, f in (("mean", "avg"), ("std", "stddev_samp")):
                out[f"{c}_roll_{name}_{n}"] = F.expr(
                    f"if(count({quoted(c)}) {frame} = {n}, {f}({quoted(c)}) {frame}, null)"
                )
    return out


def add_lags(
    df: DataFrame, entity: str, date: str, lags: Mapping[str, Sequence[int]], calendar: bool = False
) -> DataFrame:
    return checked_days(df, entity, date).withColumns(lag_columns(entity, date, lags, calendar))


def add_rolling(
    df: DataFrame, entity: str, date: str, windows: Mapping[str, Sequence[int]], calendar: bool = False
) -> DataFrame:
    return checked_days(df, entity, date).withColumns(rolling_columns(entity, date, windows, calendar))


def add_diffs(df: DataFrame, value: str, lags: Sequence[int]) -> DataFrame:
    """Value minus its lag; the lag columns must be there."""
    return df.withColumns({f"{value}_diff_{k}": F.col(value) - F.col(f"{value}_lag_{k}") for k in lags})


def add_calendar(df: DataFrame, date: str) -> DataFrame:
    sine, cosine = cyclic_doy(date)
    return df.withColumns({"day_of_year": F.dayofyear(date), "sin_doy": sine, "cos_doy": cosine})


def panel_features(
    df: DataFrame, entity: str, date: str, lags: Mapping[str, Sequence[int]],
    windows: Mapping[str, Sequence[int]], diffs: Mapping[str, Sequence[int]], calendar: bool = False,
) -> DataFrame:
    """Lags, rolling statistics, differences and calendar columns in one window pass.

    ``calendar`` counts days instead of rows: a missing day is a gap, not a step.
    """
    every = {**lag_columns(entity, date, lags, calendar), **rolling_columns(entity, date, windows, calendar)}
    out = checked_days(df, entity, date).withColumns(every)
    for value, ks in diffs.items():
        out = add_diffs(out, value, ks)
    return add_calendar(out, date)


def sequences(
    df: DataFrame, entity: str, date: str, features: Sequence[str], target: str, seq_len: int = 14
) -> DataFrame:
    """One row per run of ``seq_len`` complete rows: an L x F matrix with the last row's day and target."""
    complete = checked_days(df, entity, date).select(
        entity, date, F.array(*[F.col(c).cast("float") for c in features]).alias("_step"),
        F.col(target).cast("float").alias("y"),
        *[F.col(c).isNotNull().alias(f"_has{i}") for i, c in enumerate(features)],
    )
    for i in range(len(features)):
        complete = complete.where(f"_has{i}")
    complete = complete.where("y is not null").drop(*[f"_has{i}" for i in range(len(features))])
    frame = series(entity, date).rowsBetween(-(seq_len - 1), 0)
    return (
        complete.withColumn("x", F.collect_list("_step").over(frame))  # never more than seq_len steps
        .where(F.size("x") == seq_len)
        .select(entity, F.col(date).alias("end_date"), "x", "y")
    )


def sequence_tail(df: DataFrame, n: int, col: str = "x") -> DataFrame:
    """The last ``n`` steps of each sequence; a sequence that is too short is an error."""
    short = F.raise_error(F.lit(f"sequence shorter than {n} steps")).cast(df.schema[col].dataType)
    return df.withColumn(col, F.when(F.size(col) >= n, F.slice(F.col(col), -n, n)).otherwise(short))


def time_split_by(df: DataFrame, entity: str, date: str, frac: float = 0.8) -> DataFrame:
    """Per entity, the first int(n * frac) rows in time are for training and the rest for testing."""
    row = F.row_number().over(series(entity, date))
    size = F.count("*").over(W.partitionBy(entity))
    numbered = checked_days(df, entity, date).withColumns({"_row": row, "_size": size})
    train = F.col("_row") <= F.floor(F.col("_size") * F.lit(frac))
    return numbered.withColumn("split", F.when(train, "train").otherwise("test")).drop("_row", "_size")


def time_split(df: DataFrame, date: str, tie: str, frac: float = 0.8, valid_frac: float = 0.0) -> DataFrame:
    """Split the whole table in time: train, the last part of train for validation, test.

    Rows without a day have no place in time and are left out. The cuts are found from a stored copy of the two
    order columns and its counts per day, so the rows themselves are only filtered, never sorted or moved.
    """
    df = df.where(F.col(date).isNotNull())
    places = materialise(df.select(date, tie), "places")
    days = day_counts(places, date)
    n_train = int(sum(count for _, count in days) * frac)
    in_train = before_rank(places, date, tie, days, n_train)
    if valid_frac:
        n_fit = n_train - max(int(valid_frac * n_train), 1)
        in_fit = before_rank(places, date, tie, days, n_fit)
        train = F.when(in_fit, F.lit("fit")).when(in_train, F.lit("valid"))
    else:
        train = F.when(in_train, F.lit("train"))
    return df.withColumn("split", train.otherwise(F.lit("test")))
