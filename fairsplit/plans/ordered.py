"""Global order statistics without one global sort task.

Every operator here follows the same pattern. Rows with equal values collapse
first, with map-side combining, so a value shared by a third of all rows costs
one row. The distinct values are cut into buckets at quantiles; a bucket is a
function of the value, so ties never straddle two buckets. Windows run inside
a bucket, and a table of bucket totals, at most MAX_BUCKETS rows per group,
carries what lies before each bucket.

The quantiles come from a sample, as range partitioning does it: they only
decide where buckets end. Results do not depend on them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quoted
from .attach import attach

ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 20_000
SAMPLED_ROWS_PER_BUCKET = 100


def bucket_splits(df: DataFrame, values: Sequence[str], rows: int,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> dict[str, list[float]]:
    """Inner bucket boundaries of each value column; empty for a single bucket."""
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    if buckets <= 1 or not values:
        return {v: [] for v in values}
    fraction = SAMPLED_ROWS_PER_BUCKET * buckets / rows
    source = df.select(*[F.col(quoted(v)) for v in values])
    if fraction < 1:
        source = source.sample(fraction, seed=11)
    ranks = [i / buckets for i in range(1, buckets)]
    found = source.agg(*[F.percentile_approx(quoted(v), ranks, 10 * buckets).alias(v)
                         for v in values]).first()
    return {v: sorted({x for x in found[v] or [] if math.isfinite(x)}) for v in values}


def with_buckets(df: DataFrame, splits: Mapping[str, list[float]],
                 names: Mapping[str, str]) -> DataFrame:
    """Add one bucket number per value column; ``names`` maps value to bucket column.

    Negative zero becomes zero: they are one value, but sort apart.
    """
    cut = [v for v in names if splits.get(v)]
    if cut:
        df = df.withColumns({v: F.col(quoted(v)) + F.lit(0.0) for v in cut})
        df = Bucketizer(
            splitsArray=[[-math.inf, *splits[v], math.inf] for v in cut],
            inputCols=cut, outputCols=[names[v] for v in cut], handleInvalid="keep",
        ).transform(df)
    # Never NULL, so that joins on the bucket add no filter and both of their
    # sides can share one shuffle.
    return df.withColumns({
        names[v]: F.coalesce(F.col(names[v]).cast("int"), F.lit(-1)) if v in cut else F.lit(0)
        for v in names
    })


def stack_values(df: DataFrame, values: Mapping[str, str], splits: Mapping[str, list[float]],
                 keep: Sequence[str], flags: Mapping[str, str] | None = None) -> DataFrame:
    """Long form ``(keep..., metric, value, bucket[, flag])`` of several double columns.

    ``values`` maps the metric name to its column, ``flags`` to the column of
    its flag; missing values are left out.
    """
    names = {c: f"_bucket_{i}" for i, c in enumerate(values.values())}
    wide = with_buckets(df, splits, names)
    entry = [F.struct(F.lit(m).alias("metric"), F.col(quoted(c)).alias("value"),
                      F.col(names[c]).alias("bucket"),
                      *([F.col(flags[m]).alias("flag")] if flags else []))
             for m, c in values.items()]
    long = wide.select(*keep, F.explode(F.array(*entry)).alias("_v"))
    return long.select(*keep, "_v.*").where("value IS NOT NULL")


def _levels(rows: DataFrame, by: Sequence[str], flag: Column | None = None) -> DataFrame:
    """Distinct values with counts and the rows up to them inside their bucket."""
    flagged = [] if flag is None else [F.count_if(flag).alias("n_flag")]
    counted = rows.groupBy(*by, "bucket", "value").agg(F.count(F.lit(1)).alias("n"), *flagged)
    upto = (Window.partitionBy(*by, "bucket").orderBy("value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("upto", F.sum("n").over(upto))


def _before(totals: DataFrame, by: Sequence[str]) -> Column:
    """Rows in earlier buckets of the group; the input has one row per bucket."""
    earlier = (Window.partitionBy(*by).orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def midranks(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of every distinct value: ``(by..., value, n, midrank)``."""
    levels = _levels(rows, by)
    totals = levels.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    offsets = totals.select(*by, "bucket", _before(totals, by).alias("before"))
    placed = attach(levels, offsets, [*by, "bucket"], never_null=["bucket"])
    middle = F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return placed.select(*by, "value", "n", middle.alias("midrank"))


def rank_totals(rows: DataFrame, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sums over midranks, one row per group.

    Columns: ``n``, ``n_flag``, ``rank_sum`` (over flagged rows), ``rank_sq_sum``
    (over all rows) and ``tie_sum``, the sum of c^3 - c over runs of c ties.
    Midranks inside a bucket are shifted by the rows before it only after the
    bucket has been summed, so no join back to the values is needed.
    """
    n, hit = F.col("n").cast("double"), F.col("n_flag").cast("double")
    middle = F.col("upto") - n + (n + 1) / 2
    buckets = _levels(rows, by, flag).groupBy(*by, "bucket").agg(
        F.sum("n").alias("n"),
        F.sum("n_flag").alias("n_flag"),
        F.sum(hit * middle).alias("hit_mid"),
        F.sum(n * middle).alias("mid"),
        F.sum(n * middle * middle).alias("mid_sq"),
        F.sum(n * n * n - n).alias("ties"),
    )
    shifted = buckets.withColumn("before", _before(buckets, by).cast("double"))
    before = F.col("before")
    return shifted.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("n_flag").alias("n_flag"),
        F.sum(F.col("hit_mid") + before * F.col("n_flag")).alias("rank_sum"),
        F.sum(F.col("mid_sq") + 2 * before * F.col("mid") + before * before * F.col("n"))
        .alias("rank_sq_sum"),
        F.sum("ties").alias("tie_sum"),
    )
