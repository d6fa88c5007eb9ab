"""Complete cases and the design of the propensity model.

A stored row keeps each covariate once: numbers and booleans as doubles,
categories as the position of their level. The one-hot columns are column
expressions over that narrow table and exist only inside the jobs that use them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatisticsError
from ..functions.columns import as_double, field_type, label, present, quoted, require_columns

#: A category with more levels than this is no part of a dense design: see ``levels.py``.
MAX_LEVELS = 64
UNIT = "_row_id"


@dataclass
class Covariates:
    """Covariate columns with the sorted levels of the categorical ones.

    ``shown`` are the names to report; they differ from the column names where
    the covariates were stored under other names.
    """

    names: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    shown: list[str] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        """Design columns; the alphabetically first level has none."""
        out: list[str] = []
        for name, title in zip(self.names, self.shown or self.names, strict=True):
            if name in self.levels:
                out += [f"{title}_{level}" for level in self.levels[name][1:]]
            else:
                out.append(title)
        return out

    def slots(self, prefix: str = "v") -> list[str]:
        """Stored column of each covariate."""
        return [f"{prefix}{i}" for i in range(len(self.names))]

    def encoded(self, df: DataFrame) -> list[Column]:
        """Covariates as stored: a double, or the position of the level."""
        columns = []
        for name, slot in zip(self.names, self.slots(), strict=True):
            if name in self.levels:
                levels = F.array(*[F.lit(v) for v in self.levels[name]])
                value = F.array_position(levels, F.col(quoted(name)).cast("string")) - 1
                columns.append(value.cast("double").alias(slot))
            else:
                columns.append(as_double(df, name).alias(slot))
        return columns

    def features(self, prefix: str = "v") -> list[Column]:
        """Design columns over the stored slots, in ``feature_names`` order."""
        out: list[Column] = []
        for name, slot in zip(self.names, self.slots(prefix), strict=True):
            if name in self.levels:
                out += [F.when(F.col(slot) == i, 1.0).otherwise(0.0)
                        for i in range(1, len(self.levels[name]))]
            else:
                out.append(F.col(slot))
        return out


def complete_cases(df: DataFrame, variant_column: str, control_label: str,
                   treatment_label: str, required: Sequence[str]) -> DataFrame:
    """Rows of the two arms with no missing value in any required column."""
    require_columns(df, [variant_column], "variant column")
    require_columns(df, required, "column")
    keep = label(variant_column).isin(control_label, treatment_label)
    for name in required:
        keep = keep & present(df, name).isNotNull()
    return df.where(keep)


def is_categorical(df: DataFrame, name: str) -> bool:
    return not isinstance(field_type(df, name), T.NumericType | T.BooleanType)


def rough_levels(df: DataFrame, covariates: Sequence[str]) -> dict[str, Column]:
    """Sketched number of levels of each categorical covariate, as aggregates."""
    return {c: F.approx_count_distinct(F.col(quoted(c)).cast("string"))
            for c in covariates if is_categorical(df, c)}


def find_levels(df: DataFrame, covariates: Sequence[str], max_levels: int = MAX_LEVELS,
                shown: Sequence[str] = (), rough: Mapping[str, int] | None = None) -> Covariates:
    """Levels of the categorical covariates among the given rows.

    A sketch of bounded size, ``rough`` if already known for these rows or a
    superset, first rules out columns with far too many levels, so the exact
    collection afterwards is small. Too wide is an error: no level is ever
    merged or left out.
    """
    require_columns(df, covariates, "covariate")
    titles = dict(zip(covariates, shown or covariates, strict=True))
    wide = [c for c in covariates if is_categorical(df, c)]
    if not wide:
        return Covariates(list(covariates), {}, list(shown))
    if rough is None:
        rough = df.agg(*[v.alias(c) for c, v in rough_levels(df, wide).items()]).first().asDict()
    for name in wide:
        if rough[name] > 2 * max_levels:
            raise StatisticsError(
                f"covariate '{titles[name]}' has about {rough[name]} levels; at most {max_levels} "
                "can be one-hot encoded. Leave it out or group its levels.")
    values = {c: F.col(quoted(c)).cast("string") for c in wide}
    exact = df.agg(*[F.collect_set(v).alias(f"l{i}") for i, v in enumerate(values.values())]).first()
    levels = {name: sorted(exact[i]) for i, name in enumerate(wide)}
    for name, found in levels.items():
        if len(found) > max_levels:
            raise StatisticsError(
                f"covariate '{titles[name]}' has {len(found)} levels; at most {max_levels} can be "
                "one-hot encoded. Leave it out or group its levels.")
    return Covariates(list(covariates), levels, list(shown))


def wide_covariates(df: DataFrame, covariates: Sequence[str], rough: Mapping[str, int],
                    dense: int = MAX_LEVELS) -> list[str]:
    """Categorical covariates with more than ``dense`` levels; ``rough`` are sketched numbers for these rows or more.

    A sketch settles those that are far off; the others are counted exactly, from sets of bounded size.
    """
    near = [c for c in rough if dense / 2 < rough[c] <= 2 * dense]
    exact = df.agg(*[F.count_distinct(F.col(quoted(c)).cast("string")).alias(f"n{i}") for i, c in enumerate(near)]).first() \
        if near else []
    sizes = dict(rough) | dict(zip(near, exact, strict=True))
    return [c for c in covariates if sizes.get(c, 0) > dense]


def design_matrix(df: DataFrame, covariates: Sequence[str], keep: Sequence[str] = (),
                  max_levels: int = MAX_LEVELS) -> DataFrame:
    """``keep`` plus one double column per design feature; ``levels.sparse_design`` has any number of them."""
    if not covariates:
        raise StatisticsError("A design matrix needs at least one covariate.")
    found = find_levels(df, covariates, max_levels)
    stored = df.select(*[F.col(quoted(c)) for c in keep], *found.encoded(df))
    return stored.select(*[F.col(quoted(c)) for c in keep],
                         *[f.alias(n) for f, n in
                           zip(found.features(), found.feature_names, strict=True)])


@dataclass
class ArmStats:
    """Count, means and sample variances of the features of one arm."""

    n: int
    means: list[float]
    variances: list[float]


def feature_stats(design: DataFrame, features: Sequence[Column]) -> dict[int, ArmStats]:
    """Per-arm statistics of all features, in one pass: ``{0: ..., 1: ...}``."""
    parts = []
    for i, f in enumerate(features):
        parts += [F.avg(f).alias(f"a{i}"), F.var_samp(f).alias(f"v{i}")]
    rows = design.groupBy("treated").agg(F.count(F.lit(1)).alias("n"), *parts).collect()
    width = range(len(features))
    return {r["treated"]: ArmStats(r["n"], [r[f"a{i}"] for i in width],
                                   [r[f"v{i}"] or 0.0 for i in width]) for r in rows}


def pooled_scale(arms: dict[int, ArmStats]) -> tuple[list[float], list[float]]:
    """Mean and population SD over both arms; 1 for a constant feature."""
    n = sum(a.n for a in arms.values())
    means, scales = [], []
    for j in range(len(next(iter(arms.values())).means)):
        mean = sum(a.n * a.means[j] for a in arms.values()) / n
        variance = sum((a.n - 1) * a.variances[j] + a.n * (a.means[j] - mean) ** 2
                       for a in arms.values()) / n
        eps = 2.220446049250313e-16
        constant = variance <= n * eps * variance + (n * mean * eps) ** 2
        means.append(mean)
        scales.append(1.0 if constant else math.sqrt(variance))
    return means, scales


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its standardised value (population SD)."""
    width = range(len(columns))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(quoted(c)).alias(f"a{i}") for i, c in enumerate(columns)],
                 *[F.var_pop(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    eps = 2.220446049250313e-16
    scaled = {}
    for i in width:
        mean, variance, n = row[f"a{i}"], row[f"v{i}"], row["n"]
        if mean is None:
            continue
        constant = variance <= n * eps * variance + (n * mean * eps) ** 2
        scale = 1.0 if constant else math.sqrt(variance)
        scaled[columns[i]] = (F.col(quoted(columns[i])) - mean) / scale
    return df.withColumns(scaled)
