"""Tolerant scan of an experiment CSV."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..operators.clean import ROW_ID, QualityReport, data_columns, repair
from ..operators.profile import Profile, profile_table, require_usable
from ..plans.storage import discard, materialize

EXTRA, RAW = "_extra_field", "_corrupt_record"


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of the header line; repeated names get a numbered suffix."""
    try:
        source = spark.read.csv(path, sep=sep, header=False, escape='"')
        first = source.first()
    except AnalysisException as error:
        raise DataError(f"There is no file to read at {path}") from error
    if first is None:
        raise DataError(f"{path} has no line at all.")
    require_one_header(spark, source.inputFiles())
    names: list[str] = []
    for i, name in enumerate(first):
        base = name if name else f"Unnamed: {i}"
        candidate, n = base, 0
        while candidate in names:
            n += 1
            candidate = f"{base}.{n}"
        names.append(candidate)
    return names


def require_one_header(spark: SparkSession, files: list[str]) -> None:
    """Files that are read together must begin with the same line; only first lines are read."""
    if len(files) < 2:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    headers: dict[str, str] = {}
    for name in sorted(files):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = path.getFileSystem(conf).open(path)
        codec = codecs.getCodec(path)
        stream = stream if codec is None else codec.createInputStream(stream)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        header = lines.readLine()
        lines.close()
        if header is not None:
            headers.setdefault(header, name)
    if len(headers) > 1:
        first, second = list(headers.values())[:2]
        raise DataError(f"{first} and {second} begin with different header lines.")


def open_quote(raw: Column, sep: str = ",") -> Column:
    """Whether a field of a raw line begins with a quote that the line does not close."""
    bare = F.regexp_replace(raw, '"(?:[^"]|"")*"', "")
    return F.coalesce(bare.rlike(f'(^|{re.escape(sep)})"'), F.lit(False))


def field_surplus(raw: Column, width: int, sep: str = ",") -> Column:
    """Whether a raw line has more than ``width`` fields, quotes respected."""
    bare = F.regexp_replace(raw, '"(?:[^"]|"")*"', "")
    separators = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))
    return F.coalesce(separators / len(sep) >= width, F.lit(True))


@dataclass
class Scan:
    """Stored lines of the file: parsed rows, and how many were too long."""

    rows: DataFrame
    parsed: int
    malformed: int


def scan_csv(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> Scan:
    """Read all fields as strings, skip over-long lines, pad short ones.

    The schema has one field more than the header. A line that fills it
    exactly leaves the raw text empty, a longer one shows in its field count,
    and a short one is kept with NULLs. The file is parsed once: the lines are
    stored with their number and a flag, and everything later reads that. If a
    line leaves a quoted field open, the text goes on in the next one: the file
    is then read again with records that span lines.
    """
    names = header_names(spark, path, sep)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
                          + [T.StructField(EXTRA, T.StringType()),
                             T.StructField(RAW, T.StringType())])
    # Pruned columns would change which lines count as corrupt.
    reader = spark.read.schema(schema).option("columnPruning", False)
    lines = reader.csv(path, sep=sep, header=True, mode="PERMISSIVE", enforceSchema=True,
                       columnNameOfCorruptRecord=RAW, escape='"', multiLine=multiline)
    too_long = F.col(RAW).isNull() | F.col(EXTRA).isNotNull() | field_surplus(F.col(RAW), len(names), sep)
    stored = materialize(lines.select(
        F.monotonically_increasing_id().alias(ROW_ID), too_long.alias("_too_long"),
        open_quote(F.col(RAW), sep).alias("_open"),
        *[F.col(f"c{i}") for i in range(len(names))]), "csv_lines")
    counts = stored.agg(F.count_if("_too_long").alias("bad"), F.count(F.lit(1)).alias("n"),
                        F.count_if("_open").alias("open")).first()
    if counts["open"] and not multiline:
        discard(stored)
        return scan_csv(spark, path, sep, multiline=True)
    rows = stored.where(~F.col("_too_long")).select(
        ROW_ID, *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
    return Scan(rows, counts["n"] - counts["bad"], counts["bad"])


@dataclass
class LoadedExperiment:
    data: DataFrame
    profile: Profile
    quality: QualityReport


def load_experiment_csv(spark: SparkSession, path: str, *, drop_duplicates: bool = True,
                        sep: str = ",", multiline: bool = False) -> LoadedExperiment:
    """Load, repair and profile an experiment file.

    Double-logged rows are dropped only on an identifier column; without one,
    equal rows may be different units. The returned table is a projection of
    stored rows, so reading it again neither parses nor shuffles.
    """
    scan = scan_csv(spark, path, sep, multiline)
    if not scan.parsed:
        raise DataError(f"{path} has a header but no readable line.")
    data, quality = repair(scan.rows, drop_duplicates, scan.malformed)
    if not data_columns(data):
        raise DataError(f"Every field of {path} is empty.")
    profile = profile_table(data)
    require_usable(profile)
    return LoadedExperiment(data, profile, quality)
