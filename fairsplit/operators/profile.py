"""Structural profile of a table, one row per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import is_numeric, present, quoted
from .clean import ROW_ID, data_columns

PROFILE_SCHEMA = ("position int, column string, dtype string, is_numeric boolean, "
                  "approx_distinct bigint, missing_frac double, is_binary_candidate boolean, "
                  "levels array<string>")


@dataclass
class ColumnProfile:
    column: str
    dtype: str
    is_numeric: bool
    approx_distinct: int
    missing_frac: float
    is_binary_candidate: bool
    levels: list[str]


@dataclass
class Profile:
    n_rows: int
    columns: list[ColumnProfile]

    def names(self, numeric: bool | None = None) -> list[str]:
        return [c.column for c in self.columns if numeric is None or c.is_numeric == numeric]

    @property
    def binary_candidates(self) -> list[str]:
        return [c.column for c in self.columns if c.is_binary_candidate]

    def levels(self, name: str) -> list[str]:
        return next((c.levels for c in self.columns if c.column == name), [])

    def table(self, spark) -> DataFrame:
        rows = [(i, c.column, c.dtype, c.is_numeric, c.approx_distinct, c.missing_frac,
                 c.is_binary_candidate, c.levels) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, PROFILE_SCHEMA)


def profile_table(df: DataFrame) -> Profile:
    """Two passes: extremes and sketches, then an exact test for two values.

    A column has exactly two distinct values when its smallest and largest
    differ and no value lies elsewhere; that holds for any column size and
    needs neither a shuffle nor a set of values. Only columns whose sketch is
    small are tested. Columns of numbers 0 and 1 are outcomes, not candidates.
    """
    names = data_columns(df)
    values = {c: present(df, c) for c in names}
    parts = [F.count(F.lit(1)).alias("n")]
    for i, v in enumerate(values.values()):
        parts += [F.count(v).alias(f"f{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                  F.min(v).cast("string").alias(f"slo{i}"), F.max(v).cast("string").alias(f"shi{i}"),
                  F.approx_count_distinct(v).alias(f"d{i}")]
    row = df.agg(*parts).first()
    n = row["n"]
    suspects = [i for i in range(len(names)) if row[f"f{i}"] and row[f"lo{i}"] != row[f"hi{i}"]
                and row[f"d{i}"] <= 16]
    between = {}
    if suspects:
        low_high = {i: (F.lit(row[f"lo{i}"]), F.lit(row[f"hi{i}"])) for i in suspects}
        checked = df.agg(*[F.count_if((values[names[i]] != lo) & (values[names[i]] != hi))
                           .alias(f"x{i}") for i, (lo, hi) in low_high.items()]).first()
        between = {i: checked[f"x{i}"] for i in suspects}
    columns = []
    for i, name in enumerate(names):
        numeric = is_numeric(df, name)
        two = between.get(i) == 0
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        candidate = two and not (numeric and low == 0 and high == 1)
        columns.append(ColumnProfile(
            name, df.schema[name].dataType.simpleString(), numeric, row[f"d{i}"],
            1 - row[f"f{i}"] / n if n else 0.0, candidate,
            sorted([row[f"slo{i}"], row[f"shi{i}"]]) if candidate else []))
    return Profile(n, columns)


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in load order."""
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    return ordered.limit(n).select(*[F.col(quoted(c)) for c in data_columns(df)])


def require_usable(profile: Profile) -> None:
    if not profile.binary_candidates:
        raise DataError("No column has exactly two distinct values, so none can be the "
                        "assignment.")
    if not profile.names(numeric=True):
        raise DataError("The table has no numeric column to measure.")
