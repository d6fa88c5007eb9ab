"""Joins against small or one-row-per-key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted

# A key that holds more rows than this (and more than 1/MAX_HOT of them all)
# is joined by broadcast, so that its rows stay spread over all tasks.
HOT_ROWS = 1_000_000
MAX_HOT = 20_000


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str] = (),
           never_null: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``totals`` (one row per group) to every row of ``df``.

    Without grouping keys ``totals`` is a single row and is read through an
    uncorrelated scalar subquery; with keys it is an equi-join, null-safe but
    for the keys named in ``never_null``.
    """
    names = [c for c in totals.columns if c not in by]
    if not by:
        one = totals.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("t")).scalar()
        packed = df.withColumn("_totals", one)
        return packed.select(*[F.col(quoted(c)) for c in df.columns],
                             *[F.col("_totals")[c].alias(c) for c in names])
    renamed = totals.select(*[F.col(quoted(k)).alias(f"_key_{i}") for i, k in enumerate(by)],
                            *[F.col(quoted(c)) for c in names])
    on = [F.col(quoted(k)) == F.col(f"_key_{i}") if k in never_null
          else F.col(quoted(k)).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(by)]
    return df.join(renamed, on).select(*[F.col(quoted(c)) for c in df.columns],
                                       *[F.col(quoted(c)) for c in names])


def join_levels(rows: DataFrame, levels: DataFrame, key: str, n: str, total: int,
                largest: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per ``key``.

    ``levels`` tells in column ``n`` how many of the ``total`` rows carry each
    key and ``largest`` is the maximum of ``n``. Keys above the threshold are
    at most ``total / threshold <= MAX_HOT`` many, so that part is broadcast;
    the others are joined by shuffle, where no key can fill a task.
    """
    threshold = max(hot_rows, -(-total // MAX_HOT))
    if largest <= threshold:
        return rows.join(levels.drop(n), key)
    hot = levels.where(F.col(n) > threshold).drop(n)
    cold = levels.where(F.col(n) <= threshold).drop(n)
    spread = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return spread.unionByName(rest)
