"""Result tables on disk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import quoted


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that hold only plain values."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    return df.withColumns({c: F.to_json(F.col(quoted(c))) for c in nested})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Write one table as ``parquet``, ``json`` or ``csv`` (with a header)."""
    if fmt == "csv":
        flat(df).write.mode(mode).csv(path, header=True, escape='"')
    elif fmt in ("parquet", "json"):
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError(f"Unknown table format: {fmt!r}")


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet",
                 mode: str = "error") -> dict[str, str]:
    """Write every result table below ``folder``; returns the path of each."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in tables}
    for name, table in tables.items():
        write_table(table, paths[name], fmt, mode)
    return paths
