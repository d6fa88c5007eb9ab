"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

#: Rows of an Arrow batch are handled in groups of at most this many text bytes (one row at least).
GROUP_BYTES = 8_000_000


#: Rows that Spark hands to Python at once; keeps a batch of long texts within a worker's memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by its name; the session is set to small Arrow batches, as texts can be long.

    Shuffle files are deleted when their query ends, not when the driver happens to collect its garbage: what
    later queries read is stored.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there.

    ``spark.checkpoint.dir`` names the folder; see ``plans/storage.py``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 1_000_000


def attached(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner",
             limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored table that is broadcast if it is counted to have at most ``limit`` rows, and shuffled else."""
    few = small.count() <= limit
    return big.join(F.broadcast(small) if few else small, on, how)


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(modulus)


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut to groups of rows of about ``limit`` bytes, with their texts as UTF-8."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(column).cast(pa.binary()).to_pylist()
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))
