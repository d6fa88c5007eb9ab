"""Metric shifts between control and treatment.

One pass over the data yields the moments of all metrics in all arms; what
follows works on that table of one row per (group, metric, arm). Mann-Whitney
ranks are the only second pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, label, raise_first_issue, require_columns, require_metrics
from ..functions.intervals import cohens_h, newcombe, relative_lift
from ..functions.tails import chi2_sf, normal_sf, t_critical, t_p_value
from ..plans.attach import attach
from ..plans.ordered import ROWS_PER_BUCKET, bucket_splits, rank_totals, stack_values
from ..plans.storage import materialize

# Preconditions and the significance level.
MIN_ARM_ROWS = 30
MIN_CELL = 5
ALPHA = 0.05


def arm_moments(df: DataFrame, metrics: Sequence[str], variant_column: str,
                by: Sequence[str] = ()) -> DataFrame:
    """Moments per group, metric and arm, missing values left out.

    The arm of rows without a label is NULL: they count for the metric's kind
    but for neither arm.
    """
    require_columns(df, [variant_column], "variant column")
    require_metrics(df, metrics)
    rows = df.select(*by, label(variant_column).alias("arm"),
                     *[as_double(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)])
    parts = []
    for i in range(len(metrics)):
        v = F.col(f"_m{i}")
        parts += [
            F.count(v).alias(f"_n{i}"), F.sum(v).alias(f"_s{i}"), F.avg(v).alias(f"_a{i}"),
            F.var_samp(v).alias(f"_v{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"),
            F.count_if(~v.isin(0.0, 1.0)).alias(f"_other{i}"),
        ]
    wide = rows.groupBy(*by, "arm").agg(F.count(F.lit(1)).alias("arm_rows"), *parts)
    entry = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                      F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("total"),
                      F.col(f"_a{i}").alias("mean"), F.col(f"_v{i}").alias("variance"),
                      F.col(f"_lo{i}").alias("lowest"), F.col(f"_hi{i}").alias("highest"),
                      F.col(f"_other{i}").alias("not_0_1"))
             for i, m in enumerate(metrics)]
    long = wide.select(*by, "arm", "arm_rows", F.explode(F.array(*entry)).alias("_e"))
    return long.select(*by, "arm", "arm_rows", "_e.*")


def compare_arms(moments: DataFrame, control_label: str, treatment_label: str,
                 by: Sequence[str] = ()) -> DataFrame:
    """One row per group and metric: both arms side by side, the kind, the issue.

    A metric is binary when its values over the whole column, all arms
    included, are exactly 0 and 1.
    """
    is_c, is_t = F.col("arm") == control_label, F.col("arm") == treatment_label

    def of(side: Column, name: str) -> Column:
        return F.max(F.when(side, F.col(name)))

    paired = moments.groupBy(*by, "position", "metric").agg(
        F.coalesce(of(is_c, "n"), F.lit(0)).alias("n_control"),
        F.coalesce(of(is_t, "n"), F.lit(0)).alias("n_treatment"),
        of(is_c, "total").alias("control_total"),
        of(is_t, "total").alias("treatment_total"),
        of(is_c, "mean").alias("control_mean"),
        of(is_t, "mean").alias("treatment_mean"),
        of(is_c, "variance").alias("control_var"),
        of(is_t, "variance").alias("treatment_var"),
        F.when((F.min("lowest") == 0) & (F.max("highest") == 1) & (F.sum("not_0_1") == 0), "binary")
        .otherwise("continuous").alias("kind"),
    )
    n_c, n_t = F.col("n_control"), F.col("n_treatment")
    s_c, s_t = F.col("control_total"), F.col("treatment_total")
    small = F.least(s_c, n_c - s_c, s_t, n_t - s_t) < MIN_CELL
    issue = (
        F.when((n_c < MIN_ARM_ROWS) | (n_t < MIN_ARM_ROWS), F.format_string(
            "metric '%s': sample too small, an arm has fewer than 30 values (control %d, treatment %d).",
            "metric", n_c, n_t))
        .when((F.col("kind") == "binary") & small, F.format_string(
            "metric '%s': a cell of the 2x2 table is below 5, too few for chi-square.", "metric"))
        .when((F.col("kind") == "continuous") & (F.col("control_var") == 0)
              & (F.col("treatment_var") == 0), F.format_string(
            "metric '%s': both arms have zero variance.", "metric"))
    )
    return paired.withColumn("issue", issue)


def chi_square_2x2(s_c: Column, n_c: Column, s_t: Column, n_t: Column) -> Column:
    """Chi-square of the 2x2 table, without continuity correction."""
    n_c, n_t = n_c.cast("double"), n_t.cast("double")
    hits, n = s_c + s_t, n_c + n_t
    cross = s_t * (n_c - s_c) - s_c * (n_t - s_t)
    return F.try_divide(n * cross * cross, n_c * n_t * hits * (n - hits))


def welch(n_c: Column, m_c: Column, v_c: Column, n_t: Column, m_t: Column,
          v_t: Column) -> dict[str, Column]:
    """Welch's statistic with its degrees of freedom, and the pooled SD."""
    a, b = F.try_divide(v_c, n_c), F.try_divide(v_t, n_t)
    spread = F.try_divide(a * a, n_c - 1) + F.try_divide(b * b, n_t - 1)
    pooled = F.try_divide((n_c - 1) * v_c + (n_t - 1) * v_t, n_c + n_t - 2)
    return {
        "t": F.try_divide(m_t - m_c, F.sqrt(a + b)),
        "df": F.try_divide((a + b) * (a + b), spread),
        "se": F.sqrt(a + b),
        "pooled_sd": F.sqrt(pooled),
    }


def mann_whitney(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """U of treatment per group from ``(by..., value, bucket, treated)`` rows.

    Two-sided normal approximation with tie and 0.5 continuity correction.
    """
    ranks = rank_totals(rows, F.col("treated"), by)
    n, n_t = F.col("n").cast("double"), F.col("n_flag").cast("double")
    n_c = n - n_t
    u = F.col("rank_sum") - n_t * (n_t + 1) / 2
    ties = F.try_divide(F.col("tie_sum"), n * (n - 1))
    sd = F.sqrt(n_c * n_t / 12 * (n + 1 - ties))
    z = F.try_divide(F.greatest(u, n_c * n_t - u) - n_c * n_t / 2 - 0.5, sd)
    return ranks.select(*by, u.alias("u"), z.alias("u_z"))


def labelled_values(df: DataFrame, metrics: Sequence[str], variant_column: str,
                    control_label: str, treatment_label: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """The two arms with metrics as doubles ``_m0, _m1, ...`` and a flag ``treated``."""
    arm = label(variant_column)
    return df.where(arm.isin(control_label, treatment_label)).select(
        *by, (arm == treatment_label).alias("treated"),
        *[as_double(df, m).alias(f"_m{i}") for i, m in enumerate(metrics)])


def mann_whitney_test(df: DataFrame, metrics: Sequence[str], variant_column: str,
                      control_label: str, treatment_label: str, *, rows: int | None = None,
                      by: Sequence[str] = (),
                      rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mann-Whitney U of several metrics in one job: ``(by..., metric, u, u_z, u_p)``."""
    require_columns(df, [variant_column], "variant column")
    require_metrics(df, metrics)
    arms = labelled_values(df, metrics, variant_column, control_label, treatment_label, by)
    names = {m: f"_m{i}" for i, m in enumerate(metrics)}
    rows = arms.count() if rows is None else rows
    splits = bucket_splits(arms, list(names.values()), rows, rows_per_bucket)
    long = stack_values(arms, names, splits, [*by, "treated"])
    tested = mann_whitney(long, [*by, "metric"])
    return tested.withColumn("u_p", F.least(2 * normal_sf("u_z"), F.lit(1.0)))


def shift_table(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Test, interval and effect size for every row of :func:`compare_arms`.

    Adds ``u``, ``u_z``, ``u_p`` columns if the input lacks them.
    """
    for name in ("u", "u_z", "u_p"):
        if name not in compared.columns:
            compared = compared.withColumn(name, F.lit(None).cast("double"))
    n_c, n_t = F.col("n_control"), F.col("n_treatment")
    m_c, m_t = F.col("control_mean"), F.col("treatment_mean")
    s_c, s_t = F.col("control_total"), F.col("treatment_total")
    w = welch(n_c, m_c, F.col("control_var"), n_t, m_t, F.col("treatment_var"))
    ok = F.col("issue").isNull()
    binary = ok & (F.col("kind") == "binary")
    continuous = ok & (F.col("kind") == "continuous")
    low, high = newcombe(s_c, n_c, s_t, n_t)
    scored = compared.select(
        "*",
        F.when(binary, chi_square_2x2(s_c, n_c, s_t, n_t)).alias("chi2"),
        F.when(continuous, w["t"]).alias("t"),
        F.when(continuous, w["df"]).alias("t_df"),
        w["se"].alias("_se"), w["pooled_sd"].alias("_sd"),
        low.alias("_low"), high.alias("_high"),
    ).select(
        "*", chi2_sf("chi2", F.lit(1)).alias("_p_chi"), t_p_value("t", "t_df").alias("_p_t"),
        t_critical("t_df").alias("_crit"),
    )
    diff = m_t - m_c
    half = F.col("_crit") * F.col("_se")
    is_binary = F.col("kind") == "binary"
    return scored.select(
        *by, "position", "metric", "kind", "n_control", "n_treatment",
        "control_mean", "treatment_mean", diff.alias("absolute_diff"),
        relative_lift(diff, m_c).alias("relative_diff"),
        F.when(binary, F.col("_low")).when(continuous, diff - half).alias("ci_low"),
        F.when(binary, F.col("_high")).when(continuous, diff + half).alias("ci_high"),
        F.when(is_binary, "Newcombe hybrid-score (1998)")
        .otherwise("Welch (t quantile * SE, Welch-Satterthwaite df)").alias("ci_method"),
        F.when(binary, cohens_h(m_c, m_t))
        .when(continuous, F.try_divide(diff, F.col("_sd"))).alias("effect_size"),
        F.when(is_binary, "Cohen's h").otherwise("Cohen's d").alias("effect_size_kind"),
        F.when(is_binary, "chi-square (2x2)").otherwise("Welch's t-test").alias("primary_test"),
        F.coalesce("_p_chi", "_p_t").alias("primary_p_value"),
        F.when(~is_binary, "Mann-Whitney U").alias("secondary_test"),
        F.when(continuous, F.col("u_p")).alias("secondary_p_value"),
        F.lit(None).cast("double").alias("adjusted_p_value"),
        F.lit(None).cast("string").alias("adjustment_method"),
        F.when(binary, F.array(F.format_string("chi2 = %.3f", "chi2")))
        .when(continuous, F.array_compact(F.array(
            F.format_string("t = %.3f", "t"),
            F.when(F.col("u").isNotNull(), F.format_string("U = %.0f", "u"))))).alias("notes"),
        "chi2", "t", "t_df",
        F.when(continuous, F.col("u")).alias("u"),
        F.when(continuous, F.col("u_z")).alias("u_z"), "issue",
    )


def metric_tests(df: DataFrame, metrics: Sequence[str], variant_column: str,
                 control_label: str, treatment_label: str, *, by: Sequence[str] = (),
                 moments: DataFrame | None = None, on_issue: str = "raise",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Shift test of every metric, one result row per metric (and group).

    ``moments`` may pass in a stored :func:`arm_moments` table, so that a
    caller that needs it too reads the data once.
    """
    if moments is None:
        moments = materialize(arm_moments(df, metrics, variant_column, by), "moments")
    compared = compare_arms(moments, control_label, treatment_label, by)
    usable = compared.where(F.col("issue").isNull() & (F.col("kind") == "continuous"))
    sizes = usable.groupBy("metric").agg(
        F.sum(F.col("n_control") + F.col("n_treatment")).alias("rows")).collect()
    if sizes:
        ranked = sorted(r["metric"] for r in sizes)
        ranks = mann_whitney_test(df, ranked, variant_column, control_label, treatment_label,
                                  rows=max(r["rows"] for r in sizes), by=by,
                                  rows_per_bucket=rows_per_bucket)
        keys = [*by, "metric"]
        renamed = ranks.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                               "u", "u_z", "u_p")
        on = [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)]
        compared = compared.join(renamed, on, "left").drop(*[f"_r{i}" for i in range(len(keys))])
    result = shift_table(compared, by)
    if on_issue == "raise":
        result = raise_first_issue(materialize(result, "metric_tests"))
    return result


def metric_test(df: DataFrame, metric: str, variant_column: str, control_label: str,
                treatment_label: str, **options) -> DataFrame:
    """:func:`metric_tests` for a single metric."""
    return metric_tests(df, [metric], variant_column, control_label, treatment_label, **options)


def significant(p: str = "primary_p_value", adjusted: str = "adjusted_p_value",
                alpha: float = ALPHA) -> Column:
    """Significance at 5%: the adjusted p-value if there is one, else the raw one."""
    return F.coalesce(F.col(adjusted), F.col(p)) < alpha


def cuped_stats(df: DataFrame, metric: str, covariate: str, by: Sequence[str] = ()) -> DataFrame:
    """Theta and variance reduction from complete pairs, in a single pass.

    The adjusted variance is Var(Y) - theta * Cov(Y, X), so the adjusted column
    need not be read again.
    """
    require_columns(df, [metric, covariate], "metric or covariate")
    y, x = as_double(df, metric), as_double(df, covariate)
    both = df.select(*by, F.when(x.isNotNull(), y).alias("_y"), F.when(y.isNotNull(), x).alias("_x"))
    moments = both.groupBy(*by).agg(
        F.count("_y").alias("n"), F.avg("_x").alias("covariate_mean"),
        F.covar_samp("_y", "_x").alias("_cov"), F.var_samp("_x").alias("_var_x"),
        F.var_samp("_y").alias("_var_y"))
    theta = F.try_divide(F.col("_cov"), F.col("_var_x"))
    return moments.select(
        *by, F.lit(metric).alias("metric"), F.lit(covariate).alias("covariate"), "n",
        theta.alias("theta"), "covariate_mean",
        F.try_divide(theta * F.col("_cov"), F.col("_var_y")).alias("variance_reduction"),
        F.lit(f"{metric}__cuped").alias("adjusted_metric"),
        F.when(F.coalesce(F.col("_var_x"), F.lit(0.0)) == 0, F.lit(
            f"CUPED needs a covariate that varies: '{covariate}' has zero variance.")).alias("issue"))


def apply_cuped(df: DataFrame, metric: str, covariate: str, *, by: Sequence[str] = (),
                on_issue: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Add ``<metric>__cuped`` = y - theta (x - mean x); also return the statistics."""
    stats = cuped_stats(df, metric, covariate, by)
    if on_issue == "raise":
        stats = raise_first_issue(materialize(stats, "cuped"))
    y, x = as_double(df, metric), as_double(df, covariate)
    rows = attach(df, stats.select(*by, F.col("theta").alias("_theta"),
                                   F.col("covariate_mean").alias("_mean")), by)
    adjusted = y - F.col("_theta") * (x - F.col("_mean"))
    return rows.withColumn(f"{metric}__cuped", adjusted).drop("_theta", "_mean"), stats


