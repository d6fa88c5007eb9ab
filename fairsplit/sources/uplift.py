"""Adapter for uplift tables: f0 to f11, treatment, conversion, visit, exposure."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions.columns import quoted
from ..plans.storage import materialize
from .csv import scan_csv
from .sinks import write_table

# Columns of the raw and of the mapped table.
FEATURES = [f"f{i}" for i in range(12)]
REQUIRED = [*FEATURES, "treatment", "conversion", "visit"]
OUTPUT_COLUMNS = ["variant", "conversion", "visit", *FEATURES]


def _number(name: str):
    return F.col(name).cast("string").try_cast("double")


def require_uplift_columns(df: DataFrame) -> None:
    absent = sorted(set(REQUIRED) - set(df.columns))
    if absent:
        raise DataError(f"The uplift table is missing expected columns {absent}; "
                        f"it has {df.columns}.")


def map_uplift(df: DataFrame, invalid_treatment: str = "control") -> DataFrame:
    """Treatment 1 is "treatment", anything else "control"; exposure is dropped.

    ``invalid_treatment="reject"`` leaves out rows whose treatment is neither
    0 nor 1 instead of counting them as control.
    """
    require_uplift_columns(df)
    treatment = _number("treatment")
    if invalid_treatment == "reject":
        df = df.where(treatment.isin(0.0, 1.0))
    return df.select(F.when(treatment == 1, "treatment").otherwise("control").alias("variant"),
                     *[_number(c).alias(c) for c in OUTPUT_COLUMNS[1:]])


def row_word(df: DataFrame, seed: int = 0) -> Column:
    """40 hash bits of a row's content and the seed; equal rows have equal ones."""
    cells = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *cells).cast("binary"))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, sample: int | None, seed: int = 0, *, rows: int | None = None,
                stratified: bool = False) -> DataFrame:
    """Exactly ``sample`` rows, those of the smallest hashes; None, or no fewer than there are, keeps all.

    The choice depends on content and seed only. ``stratified`` keeps the split: each arm, as the mapping
    will define it, gives its share of ``sample``, rounded down, and the largest remainder is filled up.
    The hash of the last row is found by histograms, of 2^16 cells and then twice of 2^12 within one; nothing is sorted.
    Rows with that very hash (equal rows, but for chance) are numbered in their partition and each partition gives as
    many as are still due after the ones before it.
    """
    if sample is None:
        return df
    arm = F.when(_number("treatment") == 1, 1).otherwise(0) if stratified else F.lit(0)
    marked = df.withColumns({"_arm": arm, "_word": row_word(df, seed)})
    word, arm = F.col("_word"), F.col("_arm")
    cells = marked.groupBy("_arm", F.shiftright(word, _SHIFTS[0]).alias("cell")).count().collect()
    sizes: dict[int, int] = {}
    for cell in cells:
        sizes[cell["_arm"]] = sizes.get(cell["_arm"], 0) + cell["count"]
    total = sum(sizes.values())
    if sample >= total:
        return df
    due = {a: sample * n // total for a, n in sizes.items()}
    for a in sorted(sizes, key=lambda a: (-(sample * sizes[a] % total), a))[:sample - sum(due.values())]:
        due[a] += 1
    last: dict[int, tuple[int, int]] = {}
    for i, shift in enumerate(_SHIFTS):
        if i:
            inside = [(arm == a) & (F.shiftright(word, _SHIFTS[i - 1]) == cell) for a, (cell, _) in last.items()]
            cells = marked.where(reduce(or_, inside)).groupBy("_arm", F.shiftright(word, shift).alias("cell")).count().collect()
        last = {a: _reached(cells, a, due) for a in sizes}
    below = reduce(or_, [(arm == a) & (word < cell) for a, (cell, _) in last.items()])
    chosen = marked.where(below)
    for a, (cell, ties) in last.items():
        on_it = marked.where((arm == a) & (word == cell))
        if due[a] == ties:
            chosen = chosen.unionAll(on_it)
        elif due[a]:
            chosen = chosen.unionAll(_some_of(on_it, due[a]))
    return chosen.drop("_arm", "_word")


#: Bits of the hash below the cells of each histogram.
_SHIFTS = (24, 12, 0)


def _reached(cells: list, arm: int, due: dict[int, int]) -> tuple[int, int]:
    """The cell in which an arm's last row lies and how many rows it has; ``due`` is left with what is due from it."""
    own = sorted((c["cell"], c["count"]) for c in cells if c["_arm"] == arm)
    for cell, n in own:
        if n >= due[arm]:
            return cell, n
        due[arm] -= n
    raise AssertionError("fewer rows than were counted")


def _some_of(rows: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` of some rows, without sorting or a limit. The rows are stored with the number of their partition and
    their place in it, so that counting and choosing see the same numbers."""
    numbered = materialize(rows.withColumns({
        "_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ties")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    quota = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", (F.lit(n) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_quota"))
    return numbered.join(F.broadcast(quota), "_part").where("_place < _quota").select(*rows.columns)


def adaptation_stats(raw: DataFrame, mapped: DataFrame, malformed: int = 0) -> DataFrame:
    """One row: sizes, split and rates of a mapped table."""
    treatment = _number("treatment")
    before = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(
        F.coalesce(~treatment.isin(0.0, 1.0), F.lit(True))).alias("invalid_treatment_rows"))
    n = F.count(F.lit(1))
    after = mapped.agg(
        n.alias("rows_written"),
        F.round(F.try_divide(F.count_if(F.col("variant") == "treatment"), n), 4).alias("treatment_share"),
        F.round(F.try_divide(F.count_if(F.col("variant") == "control"), n), 4).alias("control_share"),
        F.round(F.avg("conversion"), 5).alias("conversion_rate"),
        F.round(F.avg("visit"), 5).alias("visit_rate"))
    one = before.select(F.struct("*").alias("b")).scalar()
    return after.withColumn("_b", one).select(
        "_b.raw_rows", F.lit(malformed).cast("bigint").alias("malformed_rows"),
        "_b.invalid_treatment_rows", "rows_written", "treatment_share", "control_share",
        "conversion_rate", "visit_rate")


def adapt_uplift(spark: SparkSession, raw_path: str, out_path: str, sample: int | None = None,
                 seed: int = 0, *, stratified: bool = False, invalid_treatment: str = "control",
                 mode: str = "error") -> Mapping[str, object]:
    """Raw uplift CSV to an analysable CSV; returns the statistics as a mapping."""
    scan = scan_csv(spark, raw_path)
    require_uplift_columns(scan.rows)
    drawn = sample_rows(scan.rows, sample, seed, rows=scan.parsed, stratified=stratified)
    mapped = materialize(map_uplift(drawn, invalid_treatment), "uplift")
    write_table(mapped, out_path, "csv", mode)
    stats = adaptation_stats(scan.rows, mapped, scan.malformed).first().asDict()
    return {**stats, "out_path": out_path}
