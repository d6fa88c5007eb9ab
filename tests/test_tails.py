"""Tail helpers against known values and numerical integration."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from fairsplit.functions import tails


def t_density(x, df):
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return scale * (1 + x * x / df) ** (-(df + 1) / 2)


def integrate(f, low, high, steps=200_000):
    x = np.linspace(low, high, steps + 1)
    y = f(x)
    return float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (high - low) / steps / 3)


def test_chi_square_known_values():
    assert tails.chi2_tail(10.0, 1) == pytest.approx(0.0015654022580025, rel=1e-12)
    assert tails.chi2_tail(10.827566170662733, 1) == pytest.approx(0.001, rel=1e-10)
    assert tails.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-12)
    assert tails.chi2_tail(0.0, 3) == 1.0


@pytest.mark.parametrize("df", [3, 4, 5, 8, 11])
def test_chi_square_is_the_integral_of_its_density(df):
    norm = 2 ** (df / 2) * math.gamma(df / 2)
    for x in (0.5, 3.0, 12.0):
        tail = integrate(lambda v: v ** (df / 2 - 1) * np.exp(-v / 2) / norm, x, x + 120)
        assert tails.chi2_tail(x, df) == pytest.approx(tail, rel=1e-8)


def test_t_known_value():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(2 * (1 - 0.96330598), rel=1e-6)


@pytest.mark.parametrize("df", [29.0, 57.3, 800.5, 9999.0, 10001.0, 250_000.0])
def test_t_is_the_integral_of_its_density(df):
    for t in (0.3, 1.96, 4.0):
        tail = 2 * integrate(lambda v: t_density(v, df), t, t + 60)
        assert tails.t_two_sided(t, df) == pytest.approx(tail, rel=1e-8)


def test_t_quantile_inverts_the_tail():
    for df in (29.0, 120.0, 5e4, 1e9):
        assert tails.t_two_sided(tails.t_975(df), df) == pytest.approx(0.05, rel=1e-10)
    assert tails.t_975(1e12) == pytest.approx(tails.Z_975, abs=1e-9)


def test_normal_tail_keeps_small_values():
    assert tails.normal_tail(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert 0 < tails.normal_tail(30.0) < 1e-190


def test_missing_stays_missing(spark):
    rows = spark.createDataFrame([(1.0, 1), (None, 1)], "x double, k int")
    out = [r[0] for r in rows.select(tails.chi2_sf("x", "k")).collect()]
    assert out[0] == pytest.approx(0.31731050786)
    assert out[1] is None


@pytest.mark.parametrize("x, df, low, high", [
    (1e10, 78, 0, 0), (1e8, 100, 0, 0), (1e6, 150, 0, 0), (1500, 1500, 0.49, 0.5), (1490, 1490, 0.49, 0.5),
    (1501, 1501, 0.49, 0.5), (0, 4, 1, 1), (1e-12, 2000, 1, 1), (1e4, 10_001, 0.49, 0.51)])
def test_chi_square_tail_of_large_arguments(x, df, low, high):
    assert low <= tails.chi2_tail(x, df) <= high


def summed(x, df):
    """The closed form with every term, whatever the number of degrees."""
    half, whole = x / 2.0, df % 2 == 0
    shift = 0.0 if whole else 0.5
    terms = [math.exp((j - shift) * math.log(half) - half - math.lgamma(j - shift + 1.0))
             for j in range(0 if whole else 1, df // 2 + (0 if whole else 1))]
    return (0.0 if whole else math.erfc(math.sqrt(half))) + math.fsum(terms)


@pytest.mark.parametrize("df", [101, 102, 150, 1001, 5000])
def test_chi_square_of_many_degrees_agrees_with_the_sum(df):
    for z in (-8, -3, -0.5, 0, 0.5, 3, 8, 20):
        x = max(df + z * math.sqrt(2 * df), df / 20)
        want = summed(x, df)
        assert tails.chi2_tail(x, df) == pytest.approx(want, rel=1e-9, abs=1e-15)


def test_chi_square_of_a_million_degrees_is_quick(spark):
    df = np.full(2_000, 1e6)
    x = 1e6 + np.linspace(-5e4, 5e4, 2_000)
    start = time.perf_counter()
    got = tails.chi2_tails(x, df)
    assert (time.perf_counter() - start) / 2_000 < 1e-3
    # Wilson and Hilferty's cube root is normal to a few parts in a million here.
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    assert got == pytest.approx([tails.normal_tail(v) for v in z], rel=2e-3, abs=1e-6)
    assert (np.diff(got) <= 0).all()
    rows = spark.createDataFrame([(1e6 + 10.0, 10**6), (3.0, 2), (None, 10**6)], "x double, k long")
    found = [r[0] for r in rows.select(tails.chi2_sf("x", "k")).collect()]
    assert found == [pytest.approx(tails.chi2_tail(1e6 + 10, 10**6)), pytest.approx(math.exp(-1.5)), None]
