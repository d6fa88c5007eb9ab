"""Propensity-score matching from a table of units to result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatisticsError
from ..functions.columns import as_double, field_type, label, present, quoted, require_columns, require_metrics
from ..operators.design import (ArmStats, Covariates, complete_cases, feature_stats, find_levels,
                                is_categorical, pooled_scale, rough_levels, wide_covariates)
from ..operators.effects import (GAMMA_GRID, balance, bootstrap_effects, bootstrap_summary,
                                 rosenbaum_bounds, signed_rank_totals, smd_column)
from ..operators.levels import Levels
from ..operators.logistic import Block
from ..operators.matching import (UNIT, match_counts, matched_pairs, nearest_controls,
                                  within_caliper)
from ..operators.propensity import common_support, fit_propensity, logit
from .attach import HOT_ROWS
from .branches import run_branches
from .ordered import ROWS_PER_BUCKET, bucket_splits
from .storage import discard, materialize

RESULT_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("covariates", T.ArrayType(T.StringType())),
    T.StructField("n_treated", T.LongType()),
    T.StructField("n_control_pool", T.LongType()),
    T.StructField("n_matched_pairs", T.LongType()),
    T.StructField("naive_effect", T.DoubleType()),
    T.StructField("psm_att", T.DoubleType()),
    T.StructField("att_ratio", T.DoubleType()),
    T.StructField("psm_se_paired_t", T.DoubleType()),
    T.StructField("psm_se_bootstrap", T.DoubleType()),
    T.StructField("psm_ci_low", T.DoubleType()),
    T.StructField("psm_ci_high", T.DoubleType()),
    T.StructField("psm_p_value", T.DoubleType()),
    T.StructField("caliper_sd", T.DoubleType()),
    T.StructField("caliper", T.DoubleType()),
    T.StructField("discarded_treated", T.LongType()),
    T.StructField("trimmed_treated", T.LongType()),
    T.StructField("trimmed_control", T.LongType()),
    T.StructField("bootstrap_resamples", T.LongType()),
    T.StructField("gamma_critical", T.DoubleType()),
    T.StructField("notes", T.ArrayType(T.StringType())),
])
BALANCE_SCHEMA = "metric string, covariate string, smd_before double, smd_after double"
SENSITIVITY_SCHEMA = "metric string, gamma double, upper_p double"


class PsmTables(NamedTuple):
    """One row per metric, the long balance table, the hidden-bias bounds."""

    result: DataFrame
    balance: DataFrame
    sensitivity: DataFrame


class _Rows(NamedTuple):
    result: list[Row]
    balance: list[tuple]
    sensitivity: list[tuple]
    wide_balance: list[DataFrame]


def propensity_score_match(
    df: DataFrame, metrics: str | Sequence[str], variant_column: str, control_label: str,
    treatment_label: str, covariates: Sequence[str], caliper_sd: float = 0.2,
    bootstrap_samples: int = 500, rosenbaum_grid: Sequence[float] = GAMMA_GRID,
    random_state: int = 0, *, row_id: str | None = None, direction: str = "upper",
    max_levels: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
    hot_rows: int = HOT_ROWS,
) -> PsmTables:
    """Effect on the treated by 1-NN caliper matching on the propensity logit.

    The complete cases are stored once, narrow. Metrics that miss the same rows
    among them share one model and one match, those without missing values for
    instance; the matches of different gaps run at the same time. ``row_id`` names a unique column that
    settles ties between controls (text is compared as text); without it row numbers are drawn when the
    complete cases are stored. ``direction="auto"`` bounds a negative effect in
    its own direction instead of always testing the upper tail. Categories may have any number of levels;
    ``max_levels`` refuses more.
    """
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    if not covariates:
        raise StatisticsError("Matching needs at least one covariate.")
    require_columns(df, [variant_column], "variant column")
    require_columns(df, covariates, "covariate")
    require_columns(df, metrics, "metric")
    require_metrics(df, metrics)

    row_id = row_id or (UNIT if UNIT in df.columns else None)
    unit = F.col(quoted(row_id)) if row_id else F.monotonically_increasing_id()
    if row_id and isinstance(field_type(df, row_id), T.IntegralType):
        unit = unit.cast("bigint")
    complete = complete_cases(df, variant_column, control_label, treatment_label, covariates)
    columns = {name: f"x{i}" for i, name in enumerate(covariates)}
    outcomes = {m: f"y{i}" for i, m in enumerate(metrics)}
    stored = materialize(complete.select(
        unit.alias(UNIT), (label(variant_column) == treatment_label).cast("int").alias("treated"),
        *[(present(df, c).cast("string") if is_categorical(df, c) else as_double(df, c)).alias(x)
          for c, x in columns.items()],
        *[as_double(df, m).alias(y) for m, y in outcomes.items()],
    ), "complete_cases")

    spark = df.sparkSession
    rough = rough_levels(stored, list(columns.values()))
    gaps = {m: F.col(y).isNull() for m, y in outcomes.items()}

    def repeated() -> Row | None:
        return stored.groupBy(UNIT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first() if row_id else None

    def counted() -> Row:
        # Metrics with one gap have as many rows without a value as rows where both lack it.
        both = [F.count_if(gaps[m] & gaps[o]).alias(f"g_{outcomes[m]}_{outcomes[o]}")
                for i, m in enumerate(metrics) for o in metrics[i:]]
        return stored.agg(F.count(F.lit(1)).alias("n"), *both, *[v.alias(c) for c, v in rough.items()]).first()

    checked = run_branches(spark, {"units": repeated, "gaps": counted})
    twice, filled = checked["units"], checked["gaps"]
    if twice is not None:
        raise StatisticsError(f"'{row_id}' does not tell units apart: {twice[UNIT]!r} has {twice['n']} rows.")
    rough = {c: filled[c] for c in rough}
    groups = _same_gaps(metrics, outcomes, filled)

    def branch(group: list[str]):
        ys = {m: outcomes[m] for m in group}
        y = ys[group[0]]
        rows = stored.where(F.col(y).isNotNull()) if filled[f"g_{y}_{y}"] else stored
        return lambda: _match(rows, ys, columns, caliper_sd, bootstrap_samples, rosenbaum_grid,
                              random_state, direction, max_levels, rough, rows_per_bucket, hot_rows)

    found = _Rows([], [], [], [])
    parts = run_branches(spark, {f"match-{outcomes[group[0]]}": branch(group) for group in groups})
    for part in parts.values():
        for target, new in zip(found, part, strict=True):
            target.extend(new)
    discard(stored)
    order = {m: i for i, m in enumerate(metrics)}
    return PsmTables(
        spark.createDataFrame(sorted(found.result, key=lambda r: order[r["metric"]]), RESULT_SCHEMA),
        reduce(DataFrame.unionByName, found.wide_balance, spark.createDataFrame(found.balance, BALANCE_SCHEMA)),
        spark.createDataFrame(found.sensitivity, SENSITIVITY_SCHEMA))


def _same_gaps(metrics: Sequence[str], outcomes: dict[str, str], counts: Row) -> list[list[str]]:
    """Metrics in groups that lack a value in the same rows; the group without gaps comes first."""
    groups: list[list[str]] = []
    for m in metrics:
        y = outcomes[m]
        for group in groups:
            o = outcomes[group[0]]
            if counts[f"g_{y}_{y}"] == counts[f"g_{o}_{o}"] == counts[f"g_{o}_{y}"]:
                group.append(m)
                break
        else:
            groups.append([m])
    return sorted(groups, key=lambda group: counts[f"g_{outcomes[group[0]]}_{outcomes[group[0]]}"] > 0)


def _after_match(pairs: DataFrame, covariates: Covariates,
                 diffs: dict[str, str]) -> tuple[ArmStats, ArmStats, Row]:
    """Feature statistics of both sides of the pairs and of the differences."""
    sides = {"t": covariates.features("v"), "c": covariates.features("c_v")}
    parts = [F.count(F.lit(1)).alias("n")]
    for side, features in sides.items():
        for i, f in enumerate(features):
            parts += [F.avg(f).alias(f"{side}a{i}"), F.var_samp(f).alias(f"{side}v{i}")]
    for d in diffs.values():
        parts += [F.avg(d).alias(f"a_{d}"), F.stddev_samp(d).alias(f"s_{d}")]
    row = pairs.agg(*parts).first()
    width = range(len(sides["t"]))
    treated, control = [ArmStats(row["n"], [row[f"{s}a{i}"] for i in width],
                                 [row[f"{s}v{i}"] or 0.0 for i in width]) for s in sides]
    return treated, control, row


def _level_balance(levels: Levels, pairs: DataFrame, column: str, title: str, n_t: int, n_c: int, n_pairs: int,
                   metrics: list[str]) -> DataFrame:
    """Balance of the dummies of a wide covariate, from counts per level before and after the match."""
    def smd(treated: Column, control: Column, n_t: int, n_c: int) -> Column:
        m_t, m_c = treated / F.lit(float(n_t)), control / F.lit(float(n_c))
        v_t, v_c = (m * (1 - m) * F.lit(n / max(1.0, n - 1.0)) for m, n in ((m_t, n_t), (m_c, n_c)))
        return smd_column(m_t, m_c, v_t, v_c)

    # One row per pair and side; the counts combine before they are shuffled.
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col(column).alias("k"), F.lit(1).alias("t")),
        F.struct(F.col(f"c_{column}").alias("k"), F.lit(0).alias("t")))).alias("s")).select("s.*")
    after = sides.groupBy("k").agg(F.count_if(F.col("t") == 1).alias("t"), F.count_if(F.col("t") == 0).alias("c"))
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("t", "c")}
    table = levels.table.where("k > 0").join(after, "k", "left").select(
        F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"),
        F.concat(F.lit(f"{title}_"), "level").alias("covariate"),
        smd(F.col("n_treated"), F.col("n") - F.col("n_treated"), n_t, n_c).alias("smd_before"),
        smd(count["t"], count["c"], n_pairs, n_pairs).alias("smd_after"))
    return materialize(table, "level_balance")


def _match(rows: DataFrame, ys: dict[str, str], columns: dict[str, str], caliper_sd: float,
           bootstrap_samples: int, grid: Sequence[float], seed: int, direction: str,
           max_levels: int | None, rough: dict[str, int], rows_per_bucket: int,
           hot_rows: int) -> _Rows:
    """Match one set of complete cases and evaluate all its metrics."""
    titles = {x: name for name, x in columns.items()}
    wide = wide_covariates(rows, list(titles), rough)
    dense = [x for x in titles if x not in wide]
    sizes = {x: rough[x] for x in dense if x in rough}
    covariates = find_levels(rows, dense, shown=[titles[x] for x in dense], rough=sizes, **(
        {} if max_levels is None else {"max_levels": max_levels}))
    slots, features = covariates.slots(), covariates.features()
    blocks, levels = [], {}
    for x in wide:
        levels[x] = Levels.of(rows, F.col(x), F.col("treated") == 1)
        if max_levels is not None and levels[x].size > max_levels:
            raise StatisticsError(f"covariate '{titles[x]}' has {levels[x].size} levels; at most {max_levels} are allowed.")
        rows = levels[x].number(rows, F.col(x), f"w_{x}")
        blocks.append(Block(f"w_{x}", levels[x].table.select("k", "n"), levels[x].size, levels[x].total, levels[x].largest))
    slots = [*slots, *[b.column for b in blocks]]
    design = rows.select(UNIT, "treated", *covariates.encoded(rows), *[b.column for b in blocks], *ys.values())
    if blocks:
        design = materialize(design, "design")

    outcome_columns = [F.col(y) for y in ys.values()]
    arms = feature_stats(design, [*features, *outcome_columns])
    if set(arms) != {0, 1}:
        raise StatisticsError("Matching needs rows of both arms, treated and control.")
    width = len(features)
    naive = {m: arms[1].means[width + i] - arms[0].means[width + i] for i, m in enumerate(ys)}
    arms = {t: ArmStats(a.n, a.means[:width], a.variances[:width]) for t, a in arms.items()}
    means, scales = pooled_scale(arms)
    model = fit_propensity(design, features, means, scales, blocks)

    scored = model.scored(design, features).withColumn("logit", logit(F.col("p")))
    support = common_support(scored)
    caliper = caliper_sd * (support.logit_sd or 0.0)
    inside = scored.where(support.inside()).drop("p")
    units = support.treated + support.control
    splits = bucket_splits(inside, ["logit"], units, rows_per_bucket)["logit"]
    payload = [*slots, *ys.values()]
    nearest = materialize(nearest_controls(inside, splits, payload), "nearest_controls")
    counts = match_counts(nearest, caliper)
    if not counts["matched"]:
        raise StatisticsError(f"No treated unit has a control within the caliper of {caliper:.4f}.")
    diffs = {m: f"d_{y}" for m, y in ys.items()}
    pairs = matched_pairs(inside, within_caliper(nearest, caliper), counts["matched"],
                          counts["largest"], hot_rows)
    pairs = materialize(pairs.select(
        UNIT, "control_id", "gap", *slots, *[f"c_{s}" for s in slots],
        *[(F.col(y) - F.col(f"c_{y}")).alias(diffs[m]) for m, y in ys.items()]), "pairs")

    spark = rows.sparkSession
    b, n_pairs = bootstrap_samples, counts["matched"]

    def effects():
        treated, control, effect = _after_match(pairs, covariates, diffs)
        return treated, control, effect, {m: effect[f"a_{d}"] for m, d in diffs.items()}

    def bounded():
        sizes = pairs.select(*[F.abs(d).alias(f"d{i}") for i, d in enumerate(diffs.values())])
        cuts = bucket_splits(sizes, sizes.columns, n_pairs, rows_per_bucket)
        att = pairs.agg(*[F.avg(d).alias(d) for d in diffs.values()]).first() if direction == "auto" else None
        sign = {m: -1 for m, d in diffs.items() if att is not None and att[d] < 0}
        return rosenbaum_bounds(signed_rank_totals(pairs, diffs, cuts, sign), grid).collect()

    def resampled():
        return materialize(bootstrap_effects(pairs, diffs, b, seed, n_pairs), "resamples")

    # All three read the stored pairs only.
    after = run_branches(spark, {"effects": effects, "resamples": resampled, "bounds": bounded})
    (treated, control, effect, att), drawn, bounds = after["effects"], after["resamples"], after["bounds"]
    estimates = spark.createDataFrame(list(att.items()), "metric string, psm_att double")
    boot = {r["metric"]: r for r in bootstrap_summary(drawn, estimates).collect()}
    discard(drawn)
    for r in boot.values():
        if (r["resamples"] or 0) < 2:
            raise StatisticsError("Fewer than two resamples have an effect.")
    found = _Rows([], [], [], [])
    for x, block in zip(wide, blocks, strict=True):
        found.wide_balance.append(_level_balance(
            levels[x], pairs, block.column, titles[x], arms[1].n, arms[0].n, n_pairs, list(diffs)))
    discard(nearest, pairs, *([design] if blocks else []), *model.level_weights)
    before = balance(covariates.feature_names, arms[1], arms[0])
    after = balance(covariates.feature_names, treated, control)
    for m, d in diffs.items():
        curve = sorted((r["gamma"], r["upper_p"]) for r in bounds if r["metric"] == m)
        critical = next((g for g, p in curve if p > 0.05), None)
        deviation = effect[f"s_{d}"]
        found.result.append(Row(
            metric=m, covariates=list(columns), n_treated=arms[1].n, n_control_pool=arms[0].n,
            n_matched_pairs=n_pairs, naive_effect=naive[m], psm_att=att[m],
            att_ratio=abs(att[m]) / abs(naive[m]) if abs(naive[m]) > 1e-9 else None,
            psm_se_paired_t=None if deviation is None else deviation / n_pairs ** 0.5,
            psm_se_bootstrap=boot[m]["psm_se_bootstrap"], psm_ci_low=boot[m]["psm_ci_low"],
            psm_ci_high=boot[m]["psm_ci_high"], psm_p_value=boot[m]["psm_p_value"],
            caliper_sd=float(caliper_sd), caliper=caliper,
            discarded_treated=counts["discarded"], trimmed_treated=support.trimmed_treated,
            trimmed_control=support.trimmed_control, bootstrap_resamples=b,
            gamma_critical=critical,
            notes=[f"{b} resamples; pairs up to {caliper:.4f} apart in log-odds"]))
        found.balance.extend((m, name, before[name], after[name]) for name in before)
        found.sensitivity.extend((m, g, p) for g, p in curve)
    return found
