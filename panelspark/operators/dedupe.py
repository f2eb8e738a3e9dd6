"""De-duplication. Every step reduces the copies of a key within each task before it shuffles them, so no
group is gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions.scalars import null_safe, quoted, valid_count
from panelspark.session import materialise


_WORDS = 1 << 20  # rows of the table of 64-bit words that marks repeated fingerprints, at most 16 MiB


def drop_full_duplicates(df: DataFrame, fingerprints: bool = False, bits: int = 128) -> DataFrame:
    """One of each set of equal rows.

    With ``fingerprints``, for wide rows: only fingerprints of all rows are shuffled. Rows whose fingerprint occurs
    once stay where they are, the others are compared whole, so that a collision costs work and no row. ``df`` is
    read three times then and must give the same rows each time; the first pass runs at once. ``bits`` is the length
    of a fingerprint.
    """
    if not fingerprints or not df.columns:
        return df.dropDuplicates()
    once, repeated = _by_fingerprint(df, _marked_words(_fingerprint_counts(df, bits)), bits)
    return once.unionAll(repeated.dropDuplicates())


def duplicate_count(df: DataFrame, fingerprints: bool = False, bits: int = 128) -> DataFrame:
    """Rows, and rows beyond the first of each set of equal rows; ``fingerprints`` as in ``drop_full_duplicates``,
    with two readings of ``df``."""
    total, extra = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    if not fingerprints or not df.columns:
        return _copies(df).agg(total.alias("n_rows"), extra.alias("n_extra"))
    counts = materialise(_fingerprint_counts(df, bits), "fingerprints")
    _, repeated = _by_fingerprint(df, _marked_words(counts), bits)
    # fingerprints that share a bit with a repeated one are compared whole as well and add no copies
    zero = F.lit(0).cast("long")
    parts = counts.agg(total.alias("n_rows"), zero.alias("n_extra")).unionAll(_copies(repeated).agg(zero, extra))
    return parts.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_extra").alias("n_extra"))


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("copies"))


def _fingerprint(df: DataFrame, bits: int) -> tuple[Column, Column]:
    """Two hashes of a row, ``bits`` long together. Spark's hash passes over nulls, so these are hashed apart."""
    cells = [F.col(quoted(c)) for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    parts = [F.xxhash64(F.lit(i), nulls, *cells) for i in range(2)]
    lengths = min(bits, 64), max(bits - 64, 0)
    short = [p if n == 64 else p.bitwiseAND((1 << n) - 1) for p, n in zip(parts, lengths)]
    return short[0], short[1]


def _fingerprint_counts(df: DataFrame, bits: int) -> DataFrame:
    first, second = _fingerprint(df, bits)
    return df.select(first.alias("first"), second.alias("second")).groupBy("first", "second").agg(F.count("*").alias("copies"))


def _place(first: Column, second: Column) -> tuple[Column, Column]:
    """Word and bit that mark a fingerprint."""
    return first.bitwiseAND(_WORDS - 1), F.call_function("shiftleft", F.lit(1).cast("long"), second.bitwiseAND(63).cast("int"))


def _marked_words(counts: DataFrame) -> DataFrame:
    """The bits of repeated fingerprints, by word; more of them than bits only let more rows be compared whole."""
    word, bit = _place(F.col("first"), F.col("second"))
    return materialise(counts.where("copies > 1").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks")), "words")


def _by_fingerprint(df: DataFrame, words: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint occurs once, and all others with few of the former, both without a shuffle of rows."""
    taken = {c.lower() for c in df.columns}
    fresh = [next(n for i in range(len(taken) + 1) if (n := f"_{name}{i}") not in taken) for name in ("word", "marks")]
    word, bit = _place(*_fingerprint(df, bits))
    found = df.withColumn(fresh[0], word).join(F.broadcast(words.toDF(*fresh)), fresh[0], "left")
    marked = F.coalesce(F.col(fresh[1]).bitwiseAND(bit), F.lit(0)) != 0
    rows = [quoted(c) for c in df.columns]
    return found.where(~marked).select(*rows), found.where(marked).select(*rows)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row of each key in ``order`` (source position); all other columns break ties.

    Spark applies the limit of one row per key in every task before the shuffle as well, so a key with many
    rows arrives as one row per task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    if not rest and not order:
        return df.distinct()
    first = W.partitionBy(*key).orderBy(*order, *rest)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def key_conflicts(df: DataFrame, key: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Keys held by several rows, with whether any value column has more than one distinct value."""
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("n_rows"),
        _any([F.min(c) < F.max(c) for c in value_cols]).alias("_differs"),
    )
    differs = F.coalesce(F.col("_differs"), F.lit(False))
    return per_key.where("n_rows > 1").withColumn("is_conflict", differs).drop("_differs")


def conflict_totals(conflicts: DataFrame) -> DataFrame:
    return conflicts.agg(
        F.count("*").alias("n_duplicate_keys"),
        F.count_if("is_conflict").alias("n_conflict_keys"),
        F.count_if(~F.col("is_conflict")).alias("n_other_keys"),
    )


def split_by_conflict(df: DataFrame, key: Sequence[str], value_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of duplicated keys: those in conflict, and those that only complement each other."""
    keys = key_conflicts(df, key, value_cols)
    conflict = df.join(keys.where("is_conflict"), list(key), "left_semi")
    other = df.join(keys.where(~F.col("is_conflict")), list(key), "left_semi")
    return conflict, other


def merge_key_duplicates(
    df: DataFrame, key: Sequence[str], value_cols: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """One row per key: per value column the mean of its distinct values.

    The other columns come from the row with most values, the earliest in ``order`` among equals; where a key is in
    conflict their nulls are filled from its further rows.

    Smallest, largest and count per column settle every cell with at most two distinct values in one
    combinable aggregate over all rows. Only the keys with a cell of three or more values are read again, as
    (key, column, value) rows whose distinct values spread over the cluster: hand in a stored table.
    """
    others = [c for c in df.columns if c not in key and c not in value_cols]
    rows = df.withColumn("_blank", -valid_count(value_cols))
    rank = F.struct("_blank", *order, *[c for c in others if c not in order])
    aggs = []
    for i, c in enumerate(value_cols):
        aggs += [F.expr(f"{f}({quoted(c)}) as _{n}{i}") for f, n in (("count", "n"), ("min", "lo"), ("max", "hi"))]
    aggs.append(F.min(rank).alias("_best"))
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_fill{i}") for i, c in enumerate(others)]
    spots = range(len(value_cols))
    differs = ", ".join(f"_lo{i} < _hi{i}" for i in spots)
    crowded = ", ".join(f"_lo{i} < _hi{i} and _n{i} > 2" for i in spots)
    merged = rows.groupBy(*key).agg(*aggs).withColumns({
        "_conflict": F.expr(f"exists(array({differs}), d -> d)"), "_many": F.expr(f"exists(array({crowded}), d -> d)"),
    })

    merged = materialise(merged, "merged")
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    many = merged.where("_many").select(*names)
    cell = ", ".join(f"named_struct('_cell', {i}, '_value', double({quoted(c)}))" for i, c in enumerate(value_cols))
    means = (
        df.join(many, null_safe(df, key, many), "left_semi")
        .select(*key, F.explode(F.expr(f"array({cell})")).alias("_x")).select(*key, "_x.*").where("_value is not null")
        .distinct()
        .groupBy(*key, "_cell").agg(F.avg("_value").alias("_mean"))
        .groupBy(*names)
        .agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_mean"))).alias("_means"))  # one entry per column
    )
    joined = merged.join(means, null_safe(merged, key, means), "left")
    columns = []
    for c in df.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in value_cols:
            i = list(value_cols).index(c)
            columns.append(F.expr(
                f"case when _lo{i} = _hi{i} then _lo{i} when _n{i} = 2 then (_lo{i} + _hi{i}) / 2 "
                f"else try_element_at(_means, {i}) end as {quoted(c)}"
            ))
        else:
            best, fill = F.col("_best")[c], F.col(f"_fill{others.index(c)}")
            columns.append(F.when(F.col("_conflict"), F.coalesce(best, fill)).otherwise(best).alias(c))
    return joined.select(*columns)


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fail if any key occurs twice; otherwise hand the table on."""
    repeated = df.groupBy(*key).count().where("count > 1")
    example = repeated.first()
    if example is not None:
        raise ValueError(f"duplicate key {[example[k] for k in key]} ({example['count']} rows)")
    return df
