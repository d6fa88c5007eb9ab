"""A corpus pipeline of five operators; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairsplit.llm import decontaminate, language, line_dedup, near_dedup, packing
from fairsplit.llm.common import remainder, stored, table

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier can tell; texts without letters go. ``lang`` is the prediction."""
    table(spark, sf_dir, "documents")  # sets the session to small batches
    model = language.learn(docs, remainder("doc_id", 4) != 2)
    known = language.identify(docs, model, keep=COLUMNS).where(F.col("lang_pred") != language.UNKNOWN)
    return _documents(known.withColumn("lang", F.col("lang_pred")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of which no line stays goes."""
    cleaned = line_dedup.deduplicate_lines(docs, keep=("lang", "source", "n_chars"))
    left = cleaned.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    return _documents(left.withColumn("n_chars", F.length("text").cast("long")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by runs of five words."""
    gone = near_dedup.near_duplicates(docs, words=5).where(~F.col("kept")).select("doc_id").distinct()
    return _documents(docs.join(gone.hint("merge"), "doc_id", "left_anti"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; a few stray benchmark words do not matter."""
    judged = decontaminate.digest(decontaminate.contaminated_spans(
        docs, table(spark, sf_dir, "benchmark"), keep=("text", "lang", "source", "n_chars")))
    return _documents(judged.where(~F.col("contaminated")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: The first stage trains a classifier, which SQL does not state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
