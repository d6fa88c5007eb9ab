"""Multiple-testing adjustment of a table of test results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..plans.attach import HOT_ROWS, attach, join_levels
from ..plans.ordered import ROWS_PER_BUCKET, bucket_splits, with_buckets
from ..plans.storage import materialize

# Names of the methods in results.
METHODS = {"bh": "Benjamini-Hochberg FDR", "bonferroni": "Bonferroni", "none": None}


def _step_up(results: DataFrame, p_column: str, by: Sequence[str],
             splits: list[float]) -> DataFrame:
    """Adjusted value of every distinct p-value: ``(by..., _p, _bh)``.

    adj(p) is the smallest p' * m / rank(p') over all p' >= p, where tied
    values share their largest rank. Rank counts upwards and the minimum runs
    downwards; both run inside buckets of p and are completed by bucket totals.
    """
    named = results.select(*by, F.col(p_column).alias("_p")).where(F.col("_p").isNotNull())
    levels = (with_buckets(named, {"_p": splits}, {"_p": "bucket"})
              .groupBy(*by, "bucket", "_p").agg(F.count(F.lit(1)).alias("c")))
    inside = Window.partitionBy(*by, "bucket")
    up = inside.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = inside.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.withColumn("upto", F.sum("c").over(up))

    family = Window.partitionBy(*by)
    earlier = family.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(*by, "bucket").agg(F.sum("c").alias("rows"))
    sizes = sizes.select(*by, "bucket", F.sum("rows").over(family).alias("m"),
                         F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    keys = [*by, "bucket"]
    placed = attach(ranked, sizes, keys, never_null=["bucket"])
    scaled = placed.withColumn("_s", F.col("_p") * F.col("m") / (F.col("before") + F.col("upto")))

    later = family.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    best = scaled.groupBy(*keys).agg(F.min("_s").alias("_low"))
    best = best.select(*keys, F.min("_low").over(later).alias("_later"))
    done = attach(scaled.withColumn("_here", F.min("_s").over(down)), best, keys,
                  never_null=["bucket"])
    return done.select(*by, "_p", F.least("_here", "_later", F.lit(1.0)).alias("_bh"), "c")


def adjust_p_values(results: DataFrame, method: str = "bh", *, by: Sequence[str] = (),
                    p_column: str = "primary_p_value", rows: int | None = None,
                    rows_per_bucket: int = ROWS_PER_BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill ``adjusted_p_value`` and ``adjustment_method``; one family per group.

    Tests without a p-value are outside the family. A table of more than
    ``rows_per_bucket`` tests is cut into buckets of p, and a p-value that very
    many tests share is joined back without gathering them. ``rows`` is the
    number of results; it is counted if the caller does not know it.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown correction method: {method!r}")
    require_columns(results, [p_column], "p-value column")
    kept = [c for c in results.columns if c not in ("adjusted_p_value", "adjustment_method")]
    base = results.select(*kept)
    p = F.col(p_column)
    if method == "none":
        adjusted = base.withColumn("adjusted_p_value", F.lit(None).cast("double"))
    elif method == "bonferroni":
        family = base.groupBy(*by).agg(F.count(p_column).alias("_m"))
        adjusted = attach(base, family, by).withColumn(
            "adjusted_p_value", F.when(p.isNotNull(), F.least(p * F.col("_m"), F.lit(1.0)))).drop("_m")
    else:
        rows = base.count() if rows is None else rows
        large = rows > rows_per_bucket
        splits = bucket_splits(base, [p_column], rows, rows_per_bucket)[p_column] if large else []
        stepped = _step_up(base, p_column, by, splits)
        key = F.struct(*[F.col(k) for k in by], p.alias("_p")).alias("_key")
        levels = stepped.select(F.struct(*by, "_p").alias("_key"), F.col("_bh").alias("adjusted_p_value"), "c")
        tested = base.select("*", key).where(p.isNotNull())
        if large:
            levels = materialize(levels, "adjusted")
            most = levels.agg(F.max("c")).first()[0] or 0
            joined = join_levels(tested, levels, "_key", "c", rows, most, hot_rows)
        else:
            joined = tested.join(levels.drop("c"), "_key")
        untested = base.where(p.isNull()).withColumn("adjusted_p_value", F.lit(None).cast("double"))
        adjusted = joined.drop("_key").unionByName(untested)
    name = METHODS[method]
    shown = F.when(F.col("adjusted_p_value").isNotNull(), F.lit(name)) if name else F.lit(None)
    return adjusted.withColumn("adjustment_method", shown.cast("string"))
