"""Tail probabilities for result rows.

Spark SQL has no error function and no gamma or beta function, so the last
step of a test, turning one statistic into one p-value, runs as an Arrow UDF.
Only result tables (one row per metric) ever pass through here.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these helpers inside the UDF, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Z_975 = NormalDist().inv_cdf(0.975)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


#: Up to so many degrees the closed form is added up; beyond, the density is integrated at a fixed number of points.
SUMMED_DEGREES = 100
_POINTS, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def chi2_tails(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tails of chi-square for more than SUMMED_DEGREES degrees, at a cost that does not depend on them.

    The regularised incomplete gamma function by quadrature: from x to where the density has fallen by e^-45, on the side
    that holds the smaller tail. The log density is written around its mode, so that nothing large cancels.
    """
    shape = np.maximum(df / 2.0 - 1.0, 1.0)
    at = np.maximum(x / 2.0, 1e-300)
    upper = at >= shape
    # Bounds on how far the density takes to fall: by its slope at x and by its curvature.
    with np.errstate(divide="ignore", over="ignore"):
        slope = np.abs(1.0 - shape / at)
        far = np.where(upper, 45.0 + np.sqrt(2025.0 + 90.0 * at), np.sqrt(90.0 * at))
        reach = np.minimum(far, 45.0 / slope)
    reach = np.where(upper, reach, np.minimum(reach, at))
    side = np.where(upper, 1.0, -1.0)
    t = at[:, None] + side[:, None] * reach[:, None] * (_POINTS + 1.0) / 2.0
    u = t / shape[:, None] - 1.0
    # Stirling's series of the factorial of the shape.
    series = 1 / (12 * shape) - 1 / (360 * shape**3) + 1 / (1260 * shape**5) - 1 / (1680 * shape**7)
    log_density = -shape[:, None] * (u - np.log1p(np.maximum(u, -1 + 1e-300))) - (
        0.5 * np.log(2 * np.pi * shape) + series)[:, None]
    part = np.minimum(1.0, (np.exp(log_density) @ _WEIGHTS) * reach / 2.0)
    return np.where(x <= 0.0, 1.0, np.where(upper, part, 1.0 - part))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square; closed form for a whole number of degrees up to SUMMED_DEGREES."""
    if df > SUMMED_DEGREES:
        return float(chi2_tails(np.array([x], float), np.array([df], float))[0])
    half = x / 2.0
    if half <= 0.0:
        return 1.0
    # Every term is scaled before it is added, so large arguments neither overflow nor cancel.
    whole = df % 2 == 0
    log_half, shift = math.log(half), 0.0 if whole else 0.5
    total = 0.0 if whole else math.erfc(math.sqrt(half))
    for j in range(0 if whole else 1, df // 2 + (0 if whole else 1)):
        power = j - shift
        total += math.exp(power * log_half - half - math.lgamma(power + 1.0))
    return min(1.0, total)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 5000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with a real number of degrees."""
    if df > 1e4:
        # Normalising expansion; its error here is far below 1e-12.
        a = df - 0.5
        w = math.sqrt(a * math.log1p(t * t / df))
        return 2.0 * normal_tail(w + (w**3 + 3.0 * w) / (48.0 * a * a))
    return beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def t_975(df: float) -> float:
    """0.975 quantile of Student's t: the normal one with an expansion in 1/df, then secant steps."""
    z, n = Z_975, 1.0 / df
    older = z
    newer = z + (z**3 + z) / 4 * n + (5 * z**5 + 16 * z**3 + 3 * z) / 96 * n * n
    gap = t_two_sided(older, df) - 0.05
    for _ in range(60):
        now = t_two_sided(newer, df) - 0.05
        if now == gap or abs(newer - older) < 1e-14 * newer:
            break
        older, newer, gap = newer, max(z, newer - now * (newer - older) / (now - gap)), now
    return newer


def _each(function, *columns: pd.Series) -> pd.Series:
    rows = zip(*columns, strict=True)
    return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in rows],
                     dtype="float64")


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return _each(normal_tail, z)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    many = (df > SUMMED_DEGREES) & x.notna()
    out = _each(lambda v, k: chi2_tail(v, int(k)), x.mask(many), df)
    if many.any():
        out[many] = chi2_tails(x[many].to_numpy(float), df[many].to_numpy(float))
    return out


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    return _each(t_975, df)
