"""Metric tests, CUPED and corrections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairsplit import StatisticsError, adjust_p_values, apply_cuped, metric_test, metric_tests
from fairsplit.functions import tails
from fairsplit.functions.intervals import newcombe, wilson
from fairsplit.operators.metrics import mann_whitney_test, significant


def arrays(df, metric):
    p = df.toPandas()
    return (p.loc[p.variant == "control", metric].to_numpy(float),
            p.loc[p.variant == "treatment", metric].to_numpy(float))


def brute_u(control, treatment):
    both = pd.Series(np.concatenate([treatment, control]))
    ranks = both.rank().to_numpy()
    n_t, n_c = len(treatment), len(control)
    n = n_t + n_c
    u = ranks[:n_t].sum() - n_t * (n_t + 1) / 2
    c = both.value_counts().to_numpy().astype(float)
    sd = math.sqrt(n_t * n_c / 12 * (n + 1 - (c**3 - c).sum() / (n * (n - 1))))
    z = (max(u, n_t * n_c - u) - n_t * n_c / 2 - 0.5) / sd
    return u, min(1.0, 2 * tails.normal_tail(z))


def test_continuous_metric(balanced):
    r = metric_test(balanced, "revenue", "variant", "control", "treatment").first()
    control, treatment = arrays(balanced, "revenue")
    a, b = control.var(ddof=1) / len(control), treatment.var(ddof=1) / len(treatment)
    t = (treatment.mean() - control.mean()) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (len(control) - 1) + b * b / (len(treatment) - 1))
    assert r["kind"] == "continuous" and r["primary_test"] == "Welch's t-test"
    assert r["t"] == pytest.approx(t, rel=1e-10)
    assert r["t_df"] == pytest.approx(df, rel=1e-10)
    assert r["primary_p_value"] == pytest.approx(tails.t_two_sided(t, df), rel=1e-9)
    assert r["ci_low"] < r["absolute_diff"] < r["ci_high"] and r["ci_low"] > 0
    u, p = brute_u(control, treatment)
    assert r["u"] == u
    assert r["secondary_p_value"] == pytest.approx(p, rel=1e-9)
    assert r["notes"] == [f"t = {t:.3f}", f"U = {u:.0f}"]


def test_binary_metric(balanced):
    r = metric_test(balanced, "converted", "variant", "control", "treatment").first()
    control, treatment = arrays(balanced, "converted")
    table = np.array([[control.sum(), len(control) - control.sum()],
                      [treatment.sum(), len(treatment) - treatment.sum()]])
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    assert r["kind"] == "binary" and "Newcombe" in r["ci_method"]
    assert r["chi2"] == pytest.approx(chi2, rel=1e-10)
    assert r["primary_p_value"] == pytest.approx(tails.chi2_tail(chi2, 1), rel=1e-9)
    assert r["ci_low"] > 0 and r["secondary_test"] is None and r["u"] is None


def test_newcombe_published_example(spark):
    """56/70 against 48/80: the published hybrid-score interval is 0.0524 to 0.3339."""
    args = F.lit(48), F.lit(80), F.lit(56), F.lit(70)
    row = spark.range(1).select(*newcombe(*args, published=True), *newcombe(*args)).first()
    assert row[0] == pytest.approx(0.0524, abs=5e-5) and row[1] == pytest.approx(0.3339, abs=5e-5)
    # The default swaps the half-widths around the difference of 0.2.
    assert 0.2 - row[2] == pytest.approx(row[1] - 0.2) and row[3] - 0.2 == pytest.approx(0.2 - row[0])


def test_wilson_of_nothing(spark):
    row = spark.range(1).select(*wilson(F.lit(0), F.lit(0)), *wilson(F.lit(0), F.lit(10))).first()
    assert math.isnan(row[0]) and math.isnan(row[1])
    assert row[2] == pytest.approx(0, abs=1e-12) and row[3] == pytest.approx(0.2775, abs=1e-4)


def test_kind_looks_at_the_whole_column(spark):
    rows = spark.createDataFrame(
        [("control", i % 2) for i in range(60)] + [("treatment", i % 2) for i in range(60)]
        + [("holdout", 7)], "variant string, m int")
    r = metric_test(rows, "m", "variant", "control", "treatment").first()
    assert r["kind"] == "continuous"


def test_missing_values_and_nan_are_left_out(spark):
    rows = spark.createDataFrame(
        [(arm, float(i) if i % 4 else (None if i % 8 else float("nan")))
         for arm in ("control", "treatment") for i in range(80)], "variant string, m double")
    r = metric_test(rows, "m", "variant", "control", "treatment").first()
    assert r["n_control"] == r["n_treatment"] == 60
    assert r["absolute_diff"] == 0


@pytest.mark.parametrize("rows, message", [
    ([("control", 1.0 * i) for i in range(50)] + [("treatment", 1.0)] * 20, "sample too small"),
    ([("control", 3.0)] * 40 + [("treatment", 3.0)] * 40, "zero variance"),
    ([("control", float(i < 2)) for i in range(40)] + [("treatment", float(i < 20)) for i in range(40)],
     "below 5")])
def test_unfit_data(spark, rows, message):
    df = spark.createDataFrame(rows, "variant string, m double")
    with pytest.raises(StatisticsError, match=message):
        metric_test(df, "m", "variant", "control", "treatment")
    kept = metric_test(df, "m", "variant", "control", "treatment", on_issue="keep").first()
    assert message in kept["issue"] and kept["primary_p_value"] is None


def test_metric_must_exist_and_be_numeric(balanced):
    with pytest.raises(StatisticsError, match="not in DataFrame"):
        metric_test(balanced, "nope", "variant", "control", "treatment")
    with pytest.raises(StatisticsError, match="not numeric"):
        metric_test(balanced, "device", "variant", "control", "treatment")


@pytest.mark.parametrize("rows_per_bucket", [40, 700, 10**9])
def test_mann_whitney_in_any_number_of_buckets(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    n = 3_000
    # A third of all rows share one value.
    value = np.where(rng.random(n) < 0.35, 0.0, np.round(rng.normal(5, 3, n), 1))
    frame = pd.DataFrame({"variant": rng.choice(["control", "treatment"], n), "m": value})
    df = spark.createDataFrame(frame)
    r = mann_whitney_test(df, ["m"], "variant", "control", "treatment",
                          rows_per_bucket=rows_per_bucket).first()
    u, p = brute_u(*arrays(df, "m"))
    assert r["u"] == u
    assert r["u_p"] == pytest.approx(p, rel=1e-9)


def test_groups_match_separate_runs(balanced):
    grouped = {r["device"]: r for r in metric_tests(
        balanced, ["revenue"], "variant", "control", "treatment", by=["device"]).collect()}
    for device in ("mobile", "desktop"):
        alone = metric_test(balanced.where(F.col("device") == device), "revenue", "variant",
                            "control", "treatment").first()
        for name in ("t", "u", "ci_low", "effect_size", "secondary_p_value"):
            assert grouped[device][name] == pytest.approx(alone[name], rel=1e-9)


# --- CUPED ---------------------------------------------------------------------

def test_cuped_matches_the_definition(balanced):
    adjusted, stats = apply_cuped(balanced, "revenue", "pre_value")
    p = balanced.toPandas()
    y, x = p.revenue.to_numpy(float), p.pre_value.to_numpy(float)
    theta = np.cov(y, x)[0, 1] / x.var(ddof=1)
    want = y - theta * (x - x.mean())
    row = stats.first()
    assert row["theta"] == pytest.approx(theta, rel=1e-10)
    assert row["variance_reduction"] == pytest.approx(1 - want.var(ddof=1) / y.var(ddof=1), rel=1e-9)
    assert row["variance_reduction"] > 0
    got = adjusted.toPandas().sort_values("user_id")["revenue__cuped"].to_numpy()
    assert np.allclose(got, want)


def test_cuped_uses_complete_pairs(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)] + [(None, 3.0), (4.0, None)],
                                 "y double, x double")
    adjusted, stats = apply_cuped(rows, "y", "x")
    assert stats.first()["n"] == 10
    assert stats.first()["theta"] == pytest.approx(0.5)
    assert adjusted.where("y__cuped IS NULL").count() == 2


def test_cuped_needs_variance(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "y double, x double")
    with pytest.raises(StatisticsError, match="zero variance"):
        apply_cuped(rows, "y", "x")


# --- corrections -----------------------------------------------------------------

def least_scaled(p):
    """For every p-value the least p' * m / rank(p') over all p' that are not smaller."""
    return [min(1, *(q * len(p) / sum(x <= q for x in p) for q in p if q >= own)) for own in p]


@pytest.mark.parametrize("options", [{}, {"rows": 400, "rows_per_bucket": 30}, {"rows_per_bucket": 30, "hot_rows": 5}])
def test_bh_against_the_definition(spark, options):
    rng = np.random.default_rng(5)
    p = np.round(rng.beta(0.4, 1.5, 400), 3)  # many ties, many small values
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)],
                               "test int, primary_p_value double")
    got = adjust_p_values(df, "bh", **options).orderBy("test").toPandas()
    assert np.allclose(got["adjusted_p_value"], least_scaled(p), rtol=1e-12)
    assert (got["adjusted_p_value"] >= got["primary_p_value"] - 1e-12).all()
    assert set(got["adjustment_method"]) == {"Benjamini-Hochberg FDR"}


def test_families_are_separate(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("b", 0.04), ("b", None)],
                               "family string, primary_p_value double")
    got = sorted((r["family"], r["adjusted_p_value"]) for r in
                 adjust_p_values(df, "bh", by=["family"]).where("primary_p_value IS NOT NULL").collect())
    assert got == [("a", 0.02), ("a", 0.04), ("b", 0.04)]


def test_bonferroni_none_unknown(spark):
    df = spark.createDataFrame([(0.2,), (0.7,), (0.01,)], "primary_p_value double")
    got = [r["adjusted_p_value"] for r in
           adjust_p_values(df, "bonferroni").orderBy("primary_p_value").collect()]
    assert got == pytest.approx([0.03, 0.6, 1.0])
    assert adjust_p_values(df, "none").where("adjusted_p_value IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="Unknown correction"):
        adjust_p_values(df, "holm")


def test_significance_prefers_the_adjusted_value(spark):
    df = spark.createDataFrame([(0.01, 0.2), (0.01, None), (0.05, None)],
                               "primary_p_value double, adjusted_p_value double")
    assert [r[0] for r in df.select(significant()).collect()] == [False, True, False]
