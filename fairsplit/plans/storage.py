"""Intermediate tables that outlive a lost executor.

A table that several later jobs read is written once, as Parquet, under the
cluster's shared checkpoint folder and read back from there. That cuts the
lineage, keeps column pruning and filter pushdown for the readers, and loses
nothing when an executor goes away.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ExperimentError


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a
    cluster a machine-local folder would not be visible to the other nodes.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    configured = configured or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ExperimentError(
                "spark.checkpoint.dir is not set: it must name a folder every node can reach."
            )
        configured = tempfile.mkdtemp(prefix="fairsplit-")
        context.setCheckpointDir(configured)
    if configured.startswith("file:") and not context.master.startswith("local"):
        raise ExperimentError(f"spark.checkpoint.dir is {configured}: other nodes cannot see that folder.")
    return f"{configured.rstrip('/')}/fairsplit-{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark)).toUri().getPath()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.toUri().getPath().startswith(root):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_scratch(spark: SparkSession) -> bool:
    """Delete every intermediate table of this application."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
