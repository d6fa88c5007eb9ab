"""Closed-form intervals and effect sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tails import Z_975


def wilson(successes: Column, n: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Score interval of one proportion; NaN bounds when ``n`` is not positive."""
    n = n.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    spread = F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)
    half = z * F.sqrt(spread) / scale
    empty = F.lit(float("nan"))
    return F.when(n > 0, centre - half).otherwise(empty), F.when(n > 0, centre + half).otherwise(empty)


def newcombe(s_c: Column, n_c: Column, s_t: Column, n_t: Column, z: float = Z_975,
             published: bool = False) -> tuple[Column, Column]:
    """Hybrid-score interval of the difference treatment minus control.

    The lower half-width joins the control's lower with the treatment's upper
    limit. Newcombe's paper joins them the other way round, which swaps the two
    half-widths; ``published=True`` gives that interval.
    """
    p_c = F.try_divide(s_c.cast("double"), n_c.cast("double"))
    p_t = F.try_divide(s_t.cast("double"), n_t.cast("double"))
    low_c, high_c = wilson(s_c, n_c, z)
    low_t, high_t = wilson(s_t, n_t, z)
    first = F.hypot(p_c - low_c, high_t - p_t)
    second = F.hypot(p_t - low_t, high_c - p_c)
    below, above = (second, first) if published else (first, second)
    return p_t - p_c - below, p_t - p_c + above


def cohens_h(p_c: Column, p_t: Column) -> Column:
    return 2 * (F.asin(F.sqrt(p_t)) - F.asin(F.sqrt(p_c)))


def relative_lift(diff: Column, base: Column) -> Column:
    """Difference relative to the control mean; missing when that mean is 0."""
    return F.try_divide(diff, base)
