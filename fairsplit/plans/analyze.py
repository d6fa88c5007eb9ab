"""From a table of units to a launch verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RoutingError, StatisticsError
from ..functions.columns import is_numeric, quoted, raise_first_issue
from ..operators.clean import ROW_ID, QualityReport, data_columns
from ..operators.correction import adjust_p_values
from ..operators.metrics import apply_cuped, arm_moments, metric_tests
from ..operators.profile import Profile, profile_table
from ..operators.roles import Roles, check_roles, infer_roles, with_primary
from ..operators.srm import SRM_THRESHOLD, planned_ratio, srm_from_counts
from ..operators.verdict import decide_verdict
from .branches import run_branches
from .psm import propensity_score_match
from .storage import materialize


def choose_roles(df: DataFrame, profile: Profile | None = None, **chosen) -> Roles:
    """Roles from the caller alone when complete, else from the profile."""
    needed = ("variant_column", "control_label", "treatment_label", "primary_metric",
              "secondary_metrics", "covariates")
    if profile is None and all(chosen.get(k) is not None for k in needed):
        if chosen["variant_column"] not in df.columns:
            raise RoutingError(f"variant column {chosen['variant_column']!r} not in the table.")
        secondary = [m for m in dict.fromkeys(chosen["secondary_metrics"])
                     if m != chosen["primary_metric"]]
        roles = Roles(chosen["variant_column"], str(chosen["control_label"]),
                      str(chosen["treatment_label"]), chosen["primary_metric"], tuple(secondary),
                      tuple(chosen["covariates"]), "Given by the caller.")
        check_roles(roles, df.columns, [c for c in df.columns if is_numeric(df, c)])
        return roles
    profile = profile or profile_table(df)
    return infer_roles(df.sparkSession, profile, **chosen)


def analyze(
    df: DataFrame, *, variant_column: str | None = None, control_label: str | None = None,
    treatment_label: str | None = None, primary_metric: str | None = None,
    secondary_metrics: Sequence[str] | None = None, covariates: Sequence[str] | None = None,
    expected_ratio: Mapping[str, float] | None = None, srm_threshold: float = SRM_THRESHOLD,
    cuped: str | None = None, correction: str = "bh", profile: Profile | None = None,
    quality: QualityReport | None = None, store_input: bool = False, **psm_options,
) -> dict[str, DataFrame]:
    """All result tables of one experiment, keyed by name.

    ``srm``, ``srm_levels``, ``metric_tests``, ``verdict`` always; ``psm``,
    ``balance``, ``sensitivity`` if there are covariates; ``cuped`` and
    ``quality`` if asked for. Every step runs even when the allocation is off;
    only the verdict stops there.

    The input is read once for the moments, once for the ranks and once for
    the complete cases. If it is itself a costly query, ``store_input=True``
    first writes the columns in use to the scratch folder. Tests and match run at the same time (see
    ``branches.py``).
    """
    spark = df.sparkSession
    if expected_ratio is not None:
        planned_ratio(expected_ratio)
    roles = choose_roles(
        df, profile, variant_column=variant_column, control_label=control_label,
        treatment_label=treatment_label, primary_metric=primary_metric,
        secondary_metrics=secondary_metrics, covariates=covariates)
    if store_input:
        used = dict.fromkeys([roles.variant_column, *roles.metrics, *roles.covariates])
        extra = [c for c in (cuped, psm_options.get("row_id"), ROW_ID) if c in df.columns]
        df = materialize(df.select(*[quoted(c) for c in dict.fromkeys([*used, *extra])]), "units")
    out: dict[str, DataFrame] = {}
    adjusted = None
    if cuped is not None:
        if cuped not in data_columns(df):
            raise RoutingError(f"CUPED covariate {cuped!r} not in the table.")
        df, out["cuped"] = apply_cuped(df, roles.primary_metric, cuped)
        adjusted = f"{roles.primary_metric}__cuped"
        roles = with_primary(roles, adjusted, [c for c in roles.covariates if c != cuped])

    # The moments pass counts the arms too, so the data is read once for both.
    moments = materialize(arm_moments(df, roles.metrics, roles.variant_column), "moments")
    counts = moments.where((F.col("position") == 0) & F.col("arm").isNotNull()) \
        .select(F.col("arm").alias("level"), F.col("arm_rows").alias("observed"))
    if counts.isEmpty():
        raise StatisticsError(f"'{roles.variant_column}' shows no arm; an allocation needs two.")
    srm = srm_from_counts(counts, roles.variant_column, expected_ratio, srm_threshold)
    out["srm"] = raise_first_issue(materialize(srm.summary, "srm"))
    out["srm_levels"] = srm.levels

    matched = [m for m in roles.metrics if m != adjusted]

    def tested() -> DataFrame:
        tests = metric_tests(df, roles.metrics, roles.variant_column, roles.control_label,
                             roles.treatment_label, moments=moments)
        return materialize(adjust_p_values(tests, correction), "metric_tests")

    def matches():
        return propensity_score_match(
            df, matched, roles.variant_column, roles.control_label, roles.treatment_label,
            roles.covariates, **psm_options)

    # Ranks and match read the same units but not each other.
    branches = {"tests": tested} | ({"match": matches} if matched and roles.covariates else {})
    found = run_branches(spark, branches)
    out["metric_tests"] = found["tests"]
    psm = None
    if "match" in found:
        tables = found["match"]
        psm = tables.result
        out.update(psm=psm, balance=tables.balance, sensitivity=tables.sensitivity)
    out["verdict"] = decide_verdict(out["srm"], out["metric_tests"], psm, roles.primary_metric)
    if quality is not None:
        out["quality"] = quality.table(spark)
    out["roles"] = spark.createDataFrame(
        [(roles.variant_column, roles.control_label, roles.treatment_label, roles.primary_metric,
          list(roles.secondary_metrics), list(roles.covariates), roles.rationale, list(roles.warnings))],
        "variant_column string, control_label string, treatment_label string, "
        "primary_metric string, secondary_metrics array<string>, covariates array<string>, "
        "rationale string, warnings array<string>")
    return out
