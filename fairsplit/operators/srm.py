"""Sample ratio mismatch: observed against planned allocation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StatisticsError
from ..functions.columns import label, raise_first_issue, require_columns
from ..functions.tails import chi2_sf
from ..plans.attach import attach
from ..plans.storage import materialize

# Detection threshold and smallest expected count.
SRM_THRESHOLD = 0.001
MIN_EXPECTED = 5
# Arms that a reason lists at most; the levels table has them all.
SHOWN_ARMS = 8


class SrmTables(NamedTuple):
    """``summary`` has one row per experiment, ``levels`` one per arm of it."""

    summary: DataFrame
    levels: DataFrame


def planned_ratio(expected_ratio: Mapping[str, float]) -> dict[str, float]:
    """Checked plan; a sum within 1e-6 of one is accepted and renormalised."""
    total = sum(expected_ratio.values())
    if abs(total - 1.0) > 1e-6:
        raise StatisticsError(f"planned shares add up to {total:.6f} instead of 1.")
    return {str(k): v / total for k, v in sorted(expected_ratio.items())}


def arm_counts(df: DataFrame, variant_column: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., level, observed)`` over all non-missing labels."""
    require_columns(df, [variant_column], "variant column")
    return (df.select(*by, label(variant_column).alias("level"))
            .where(F.col("level").isNotNull())
            .groupBy(*by, "level").agg(F.count(F.lit(1)).alias("observed")))


def first_arms(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., _arms)``: the first SHOWN_ARMS arms in name order; a task keeps no more of a group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("level"))
    return (counts.withColumn("_rank", rank).where(F.col("_rank") <= SHOWN_ARMS)
            .groupBy(*by).agg(F.collect_list(F.struct("level", "observed")).alias("_arms")))


def split_text(arms: Column, n: Column, k: Column) -> Column:
    """Observed and uniform shares of the first arms in name order, for a reason."""
    shown = F.transform(F.sort_array(arms), lambda arm: F.format_string(
        "%s %.4f (planned %.4f)", arm["level"], arm["observed"] / n, 1 / k))
    rest = F.when(k > SHOWN_ARMS, F.format_string(" and %d more", k - SHOWN_ARMS))
    return F.concat(F.array_join(shown, ", "), F.coalesce(rest, F.lit("")))


def named_split(plan: Mapping[str, float], n: Column) -> Column:
    """The text of ``split_text`` for the arms of one plan, whose counts are the columns ``_o0``, ``_o1``, ..."""
    shown = [F.format_string("%s %.4f (planned %.4f)", F.lit(name), F.col(f"_o{i}") / n, F.lit(share))
             for i, (name, share) in enumerate(plan.items()) if i < SHOWN_ARMS]
    rest = f" and {len(plan) - SHOWN_ARMS} more" if len(plan) > SHOWN_ARMS else ""
    return F.concat(F.array_join(F.array(*shown), ", "), F.lit(rest))


def srm_from_counts(counts: DataFrame, variant_column: str,
                    expected_ratio: Mapping[str, float] | None = None,
                    threshold: float = SRM_THRESHOLD, by: Sequence[str] = ()) -> SrmTables:
    """Goodness-of-fit test on a table of arm counts."""
    o, n = F.col("observed"), F.col("n")
    plan = None
    if expected_ratio is None:
        # Against a uniform plan the statistic is the spread of the counts.
        grouped = counts.groupBy(*by).agg(
            F.sum(o).alias("n"), F.count(F.lit(1)).alias("k"),
            (F.var_samp(o) * (F.count(F.lit(1)) - 1) / F.avg(o)).alias("chi2"),
            F.avg(o).alias("min_expected"),
        ).withColumn("mismatch", F.lit(False))
        plan_text = "uniform"
    else:
        plan = planned_ratio(expected_ratio)
        grouped = counts.groupBy(*by).agg(
            F.sum(o).alias("n"), F.count(F.lit(1)).alias("k"),
            F.count_if(~F.col("level").isin(*plan)).alias("unplanned"),
            *[F.sum(F.when(F.col("level") == name, o)).alias(f"_o{i}")
              for i, name in enumerate(plan)],
        )
        terms = [F.pow(F.col(f"_o{i}") - r * n, F.lit(2)) / (r * n)
                 for i, r in enumerate(plan.values())]
        absent = [F.col(f"_o{i}").isNull() for i in range(len(plan))]
        grouped = grouped.select(
            *by, "n", "k",
            sum(terms[1:], terms[0]).alias("chi2"),
            (F.lit(min(plan.values())) * n).alias("min_expected"),
            F.expr("unplanned > 0").alias("_extra"),
            *[a.alias(f"_a{i}") for i, a in enumerate(absent)], *[f"_o{i}" for i in range(len(plan))],
        )
        lacking = F.col("_extra")
        for i in range(len(plan)):
            lacking = lacking | F.col(f"_a{i}")
        grouped = grouped.withColumn("mismatch", lacking)
        plan_text = str(sorted(plan))
    issue = (
        F.when(F.col("k") < 2, F.lit(f"'{variant_column}' shows a single arm; an allocation needs two."))
        .when(F.col("mismatch"), F.lit(
            f"The plan is for {plan_text}; other arms were observed, or some are absent."))
        .when(F.col("min_expected") < MIN_EXPECTED, F.lit(
            "An arm should have fewer than 5 rows: too small for the chi-square test."))
    )
    judged = grouped.withColumn("issue", issue)
    if plan is None:
        judged = attach(judged, first_arms(counts, by), by)
        split = split_text(F.col("_arms"), n, F.col("k"))
    else:
        # The counts of the planned arms are columns already; with other arms the issue says so.
        split = F.when(~F.col("mismatch"), named_split(plan, n))
    ok = F.col("issue").isNull()
    summary = judged.select(
        *by, F.lit(variant_column).alias("variant_column"), "n", "k",
        F.when(ok, F.col("chi2")).alias("chi2"),
        (F.col("k") - 1).alias("df"), "issue",
        split.alias("split"),
    ).withColumn("p_value", chi2_sf("chi2", "df"))
    unknown = F.lit("The allocation test has no p-value.")
    summary = summary.withColumn("threshold", F.lit(float(threshold))) \
        .withColumn("srm_detected", F.col("p_value") < F.col("threshold")) \
        .withColumn("issue", F.coalesce("issue", F.when(F.col("p_value").isNull(), unknown)))

    totals = counts.groupBy(*by).agg(F.sum(o).alias("n"), F.count(F.lit(1)).alias("k"))
    share = F.lit(1.0) / F.col("k")
    if expected_ratio is not None:
        share = F.lit(None).cast("double")
        for name, ratio in plan.items():
            share = F.when(F.col("level") == name, F.lit(ratio)).otherwise(share)
    levels = attach(counts, totals, by).select(
        *by, "level", "observed", share.alias("expected_ratio"),
        (o / n).alias("observed_ratio"))
    return SrmTables(summary, levels)


def srm_check(df: DataFrame, variant_column: str,
              expected_ratio: Mapping[str, float] | None = None,
              threshold: float = SRM_THRESHOLD, *, by: Sequence[str] = (),
              on_issue: str = "raise") -> SrmTables:
    """Chi-square test of the allocation over every non-missing label.

    With ``on_issue="raise"`` the arm counts are stored and a failed
    precondition raises; ``"keep"`` stays lazy and reports it in ``issue``.
    """
    counts = arm_counts(df, variant_column, by)
    if on_issue == "raise":
        counts = materialize(counts, "arm_counts")
    tables = srm_from_counts(counts, variant_column, expected_ratio, threshold, by)
    if on_issue == "raise":
        if counts.isEmpty():
            raise StatisticsError(f"'{variant_column}' shows no arm; an allocation needs two.")
        raise_first_issue(tables.summary)
    return tables


def plans_from_json(plans: DataFrame, by: Sequence[str], column: str = "plan") -> DataFrame:
    """A table of plans ``(by..., level, share)`` from one JSON object of shares per experiment.

    Text that is no such object gives no rows, and its experiment has no plan.
    """
    shares = F.from_json(F.col(column), "map<string,double>")
    return plans.select(*by, F.explode(shares).alias("level", "share"))


def srm_by_plan(df: DataFrame, variant_column: str, plans: DataFrame, by: Sequence[str],
                threshold: float = SRM_THRESHOLD) -> SrmTables:
    """The allocation test of many experiments against a plan of their own.

    ``plans`` has one row ``(by..., level, share)`` per experiment and planned arm; it is joined, so neither the number of
    experiments nor that of arms is limited. Shares must add up to one within 1e-6 and are renormalised. An experiment
    without a plan, with arms that are not planned or planned arms that are absent, with shares that are not positive or
    planned twice, has an ``issue`` and no result; a plan without rows of its experiment is left out.
    """
    counts = arm_counts(df, variant_column, by)
    planned = plans.select(*by, F.col("level").cast("string").alias("level"), F.col("share").cast("double").alias("share")) \
        .groupBy(*by, "level").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("times"))
    keys = [*by, "level"]
    left = counts.select(*[F.col(c).alias(f"_l{i}") for i, c in enumerate(keys)], "observed")
    right = planned.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(keys)], "share", "times")
    on = [F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(keys))]
    # An absent side has no count (or no number of plans), which tells it from a null key.
    pick = [F.when(F.col("observed").isNotNull(), F.col(f"_l{i}")).otherwise(F.col(f"_r{i}")).alias(c)
            for i, c in enumerate(keys)]
    both = left.join(right, on, "full").select(*pick, "observed", "share", "times")
    r, o = F.col("share"), F.col("observed")
    totals = both.groupBy(*by).agg(
        F.sum(o).alias("n"), F.count(o).alias("k"), F.sum(r).alias("planned"), F.min(r).alias("least"),
        F.max("times").alias("times"), F.count_if(o.isNull()).alias("absent"), F.count_if(r.isNull()).alias("unplanned")) \
        .where("n IS NOT NULL")
    cells = attach(both, totals.select(*by, "n", "planned"), by).withColumn("_e", F.try_divide(r, F.col("planned")) * F.col("n"))
    statistic = cells.groupBy(*by).agg(F.sum(F.try_divide(F.pow(o - F.col("_e"), F.lit(2)), F.col("_e"))).alias("chi2"),
                                       F.min("_e").alias("min_expected"))
    issue = (F.when(F.col("planned").isNull(), "The experiment has no plan.")
             .when((F.col("times") > 1) | (F.col("least") <= 0), "A planned share is not positive, or an arm is planned twice.")
             .when(F.abs(F.col("planned") - 1) > 1e-6, F.format_string("planned shares add up to %.6f instead of 1.", F.col("planned")))
             .when(F.col("k") < 2, f"'{variant_column}' shows a single arm; an allocation needs two.")
             .when((F.col("absent") > 0) | (F.col("unplanned") > 0), "Arms were observed that are not planned, or planned ones are absent.")
             .when(F.col("min_expected") < MIN_EXPECTED, "An arm should have fewer than 5 rows: too small for the chi-square test."))
    judged = attach(totals, statistic, by).withColumn("issue", issue)
    ok = F.col("issue").isNull()
    summary = judged.select(
        *by, F.lit(variant_column).alias("variant_column"), "n", "k", F.when(ok, F.col("chi2")).alias("chi2"),
        (F.col("k") - 1).alias("df"), "issue").withColumn("p_value", chi2_sf("chi2", "df")) \
        .withColumn("threshold", F.lit(float(threshold))).withColumn("srm_detected", F.col("p_value") < F.col("threshold"))
    levels = cells.select(*by, "level", "observed", F.try_divide(r, F.col("planned")).alias("expected_ratio"),
                          (o / F.col("n")).alias("observed_ratio"))
    return SrmTables(summary, levels)
