"""Propensity model, scores, common support and caliper."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatisticsError
from .logistic import Block, fit, with_level_weights

CLIP = 1e-6


@dataclass
class PropensityModel:
    """Coefficients on the standardised features, and tables with those of the levels of wide covariates."""

    intercept: float
    weights: list[float]
    means: list[float]
    scales: list[float]
    blocks: list[Block] = field(default_factory=list)
    level_weights: list[DataFrame] = field(default_factory=list)

    def linear(self, features: Sequence[Column]) -> Column:
        """Linear predictor as a plain column, so scoring stays in codegen."""
        total = F.lit(self.intercept)
        for w, m, s, f in zip(self.weights, self.means, self.scales, features, strict=True):
            total = total + F.lit(w) * ((f - F.lit(m)) / F.lit(s))
        return total

    def probability(self, features: Sequence[Column]) -> Column:
        return 1 / (1 + F.exp(-self.linear(features)))

    def scored(self, rows: DataFrame, features: Sequence[Column], name: str = "p") -> DataFrame:
        """``rows`` with their probability; wide covariates are joined with their level's weight."""
        if not self.blocks:
            return rows.withColumn(name, self.probability(features))
        levelled = with_level_weights(rows, self.blocks, self.level_weights, "_o")
        return levelled.withColumn(name, 1 / (1 + F.exp(-self.linear(features) - F.col("_o")))).drop("_o")


def logit(p: Column) -> Column:
    """Log-odds of the probability clipped away from 0 and 1."""
    clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(clipped / (1 - clipped))


def fit_propensity(design: DataFrame, features: Sequence[Column], means: Sequence[float],
                   scales: Sequence[float], blocks: Sequence[Block] = ()) -> PropensityModel:
    """L2-penalised logistic regression of ``treated`` on standardised features.

    The penalty is half the squared weights against the summed log loss with the intercept free. Dummies of a
    covariate in ``blocks`` are penalised like the other features, as if they were standardised.
    """
    scaled = [(f - F.lit(m)) / F.lit(s) for f, m, s in zip(features, means, scales, strict=True)]
    found = fit(design, "treated", scaled, blocks)
    return PropensityModel(found.intercept, found.weights, list(means), list(scales), list(blocks), found.blocks)


def support_bounds(scored: DataFrame, p: str = "p") -> tuple[float, float]:
    """Smallest treated and largest control probability."""
    treated, value = F.col("treated") == 1, F.col(p)
    row = scored.agg(F.min(F.when(treated, value)), F.max(F.when(~treated, value))).first()
    if row[0] is None or row[1] is None:
        raise StatisticsError("Matching needs rows of both arms, treated and control.")
    return row[0], row[1]


@dataclass
class Support:
    """Units of each arm in and out of the common support, and the caliper."""

    low: float
    high: float
    treated: int
    control: int
    trimmed_treated: int
    trimmed_control: int
    logit_sd: float | None

    def inside(self, p: str = "p") -> Column:
        return F.col(p).between(self.low, self.high)


def common_support(scored: DataFrame, p: str = "p", logit_column: str = "logit") -> Support:
    """Keep every unit between the smallest treated and largest control score."""
    low, high = support_bounds(scored, p)
    inside, treated = F.col(p).between(low, high), F.col("treated") == 1
    row = scored.agg(
        F.count_if(inside & treated).alias("t"), F.count_if(inside & ~treated).alias("c"),
        F.count_if(~inside & treated).alias("ot"), F.count_if(~inside & ~treated).alias("oc"),
        F.stddev_samp(F.when(inside, F.col(logit_column))).alias("sd")).first()
    if row["t"] + row["c"] == 0:
        raise StatisticsError("No unit lies in the common support: the scores of the arms "
                              "do not overlap.")
    if row["t"] == 0 or row["c"] == 0:
        raise StatisticsError("One arm lies wholly outside the common support.")
    return Support(low, high, row["t"], row["c"], row["ot"], row["oc"], row["sd"])
