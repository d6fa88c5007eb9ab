"""Nearest-neighbour caliper matching on the logit, with replacement.

The match of a unit depends on its logit alone, so the search runs on distinct
logits: units that share one collapse first, with map-side combining, into a
row that names the control with the smallest id. Inside a bucket of logits two
windows find the nearest control at or below and at or above; bucket totals
supply the neighbours that lie in another bucket. The pairs come from joining
the treated units back to their logit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.attach import HOT_ROWS, attach, join_levels
from ..plans.ordered import with_buckets
from .design import UNIT


def nearest_controls(scored: DataFrame, splits: Sequence[float], payload: Sequence[str] = (),
                     logit: str = "logit") -> DataFrame:
    """Nearest control of every distinct treated logit.

    Input columns: ``_row_id``, ``treated`` (1 or 0), the logit and numeric
    payload columns. Output: ``(logit, n_treated, control_logit, control_id,
    gap, c_<payload>...)``. At equal distance the control at or above wins.
    """
    control_id = F.when(F.col("treated") == 0, F.col(UNIT))
    cut = with_buckets(scored, {logit: list(splits)}, {logit: "bucket"})
    levels = cut.groupBy("bucket", F.col(logit).alias("logit")).agg(
        F.sum("treated").alias("n_treated"),
        F.min(control_id).alias("control_id"),
        *[F.min_by(c, control_id).alias(f"c_{c}") for c in payload])
    names = ["control_id", *[f"c_{c}" for c in payload]]
    is_control = F.col("control_id").isNotNull()
    control = F.when(is_control, F.struct(F.col("logit").alias("control_logit"), *names))

    inside = Window.partitionBy("bucket")
    up = inside.orderBy("logit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The search upwards also runs as a growing frame, over descending order:
    # a frame that ends at "unbounded following" would be rescanned per row.
    down = inside.orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = levels.select("bucket", "logit", "n_treated",
                           F.last(control, True).over(up).alias("below"),
                           F.last(control, True).over(down).alias("above"))
    wanted = "n_treated > 0"
    if splits:
        # Plain columns rather than structs keep this a hash aggregate, and
        # using every column of the levels lets it share their shuffle.
        at = F.when(is_control, F.col("logit"))
        ends = {"first": (F.min, F.min_by), "last": (F.max, F.max_by)}
        edges = levels.groupBy("bucket").agg(
            F.sum("n_treated").alias("bucket_treated"),
            *[extreme(at).alias(f"{end}_logit") for end, (extreme, _) in ends.items()],
            *[pick(c, at).alias(f"{end}_{c}") for end, (_, pick) in ends.items() for c in names])
        found = {end: F.when(F.col(f"{end}_control_id").isNotNull(), F.struct(
            F.col(f"{end}_logit").alias("control_logit"),
            *[F.col(f"{end}_{c}").alias(c) for c in names])) for end in ends}
        earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select("bucket", "bucket_treated",
                             F.last(found["last"], True).over(earlier).alias("before"),
                             F.last(found["first"], True).over(later).alias("after"))
        around = attach(around, edges, ["bucket"], never_null=["bucket"])
        around = around.withColumns({"below": F.coalesce("below", "before"),
                                     "above": F.coalesce("above", "after")})
        wanted += " AND bucket_treated > 0"
    around = around.where(wanted)
    gap_below = F.col("logit") - F.col("below.control_logit")
    gap_above = F.col("above.control_logit") - F.col("logit")
    take_above = gap_below.isNull() | (gap_above <= gap_below)
    best = F.when(take_above, F.col("above")).otherwise(F.col("below"))
    return around.select("logit", "n_treated", best.alias("_best"),
                         F.when(take_above, gap_above).otherwise(gap_below).alias("gap")) \
        .select("logit", "n_treated", "gap", "_best.*")


def within_caliper(nearest: DataFrame, caliper: float) -> DataFrame:
    return nearest.where(F.col("gap") <= caliper)


def match_counts(nearest: DataFrame, caliper: float) -> dict[str, int]:
    """Matched and discarded treated units, and the most crowded matched logit."""
    near = F.coalesce(F.col("gap") <= caliper, F.lit(False))
    row = nearest.agg(F.sum(F.when(near, F.col("n_treated"))).alias("matched"),
                      F.sum(F.when(~near, F.col("n_treated"))).alias("discarded"),
                      F.max(F.when(near, F.col("n_treated"))).alias("largest")).first()
    return {k: row[k] or 0 for k in ("matched", "discarded", "largest")}


def matched_pairs(scored: DataFrame, matches: DataFrame, total: int, largest: int,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per matched treated unit, with its control's columns.

    ``matches`` holds the kept rows of :func:`nearest_controls`; a logit shared
    by very many treated units does not gather them in one task.
    """
    treated = scored.where(F.col("treated") == 1).drop("treated")
    return join_levels(treated, matches, "logit", "n_treated", total, largest, hot_rows)
