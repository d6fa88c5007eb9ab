"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatisticsError

FRACTIONAL = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    """Column reference that survives dots and spaces in the name."""
    return "`" + name.replace("`", "``") + "`"


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numeric in the sense of a metric: booleans do not count."""
    return isinstance(field_type(df, name), T.NumericType)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that missing means one thing."""
    col = F.col(quoted(name))
    if isinstance(field_type(df, name), FRACTIONAL):
        return F.when(~F.isnan(col), col)
    return col


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric or boolean column as a double, missing as NULL."""
    if isinstance(field_type(df, name), T.BooleanType):
        return F.col(quoted(name)).cast("int").cast("double")
    return present(df, name).cast("double")


def label(name: str) -> Column:
    """Assignment labels are compared as strings whatever their type."""
    return F.col(quoted(name)).cast("string")


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    for name in names:
        if name not in df.columns:
            raise StatisticsError(f"{what} '{name}' not in DataFrame.")


def require_metrics(df: DataFrame, names: Iterable[str]) -> None:
    require_columns(df, names, "metric column")
    for name in names:
        if not is_numeric(df, name):
            raise StatisticsError(f"metric '{name}' is not numeric.")


def raise_first_issue(result: DataFrame) -> DataFrame:
    """Raise the first non-null ``issue`` of a stored result table."""
    row = result.where(F.col("issue").isNotNull()).select("issue").first()
    if row is not None:
        raise StatisticsError(row["issue"])
    return result
