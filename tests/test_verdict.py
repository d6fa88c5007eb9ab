"""Verdict rules and the whole analysis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fairsplit import RoutingError, StatisticsError, analyze, decide_verdict, load_experiment_csv
from fairsplit.operators import verdict as v

SRM = "srm_detected boolean, p_value double, threshold double"
METRIC = ("metric string, primary_p_value double, adjusted_p_value double, primary_test string, "
          "adjustment_method string")
PSM = "metric string, naive_effect double, psm_att double, psm_ci_low double, psm_ci_high double"


@pytest.mark.parametrize("detected, p, psm, verdict, rule", [
    (True, 0.001, (1.0, 1.0, 0.5, 1.5), v.COMPROMISED, 1),
    (False, 0.001, (1.0, -0.2, -0.5, 0.1), v.COMPROMISED, 2),
    (False, 0.001, (1.0, 0.4, -0.1, 0.9), v.COMPROMISED, 3),
    (False, 0.001, (1.0, 0.4, 0.1, 0.9), v.SAFE, 4),
    (False, 0.001, (1.0, 0.6, -0.1, 1.2), v.SAFE, 4),
    (False, 0.001, None, v.SAFE, 4),
    (False, 0.001, (0.0, -1.0, -2.0, 1.0), v.SAFE, 4),
    (False, 0.2, (1.0, -0.2, -0.5, 0.1), v.NO_EFFECT, 5),
    (False, None, None, v.NO_EFFECT, 5)])
def test_rules(spark, detected, p, psm, verdict, rule):
    srm = spark.createDataFrame([(detected, 1e-9 if detected else 0.5, 0.001)], SRM)
    tests = spark.createDataFrame([("m", p, None, "t", None), ("other", 1e-9, None, "t", None)], METRIC)
    matched = spark.createDataFrame([("m", *psm), ("other", 1.0, -1.0, -1.0, 1.0)], PSM) if psm else None
    row = decide_verdict(srm, tests, matched, "m").first()
    assert (row["verdict"], row["rule"]) == (verdict, rule)
    assert len(row["reasons"]) == 1 and row["reasons"][0]


def test_an_unknown_split_never_passes(spark):
    tests = spark.createDataFrame([("m", 0.001, None, "t", None)], METRIC)
    srm = spark.createDataFrame([(None, None, 0.001)], SRM)
    row = decide_verdict(srm, tests, None, "m").first()
    assert (row["verdict"], row["rule"]) == (v.UNKNOWN_SPLIT, 0)


def test_adjusted_p_decides(spark):
    srm = spark.createDataFrame([(False, 0.5, 0.001)], SRM)
    tests = spark.createDataFrame([("m", 0.01, 0.06, "t", "Bonferroni")], METRIC)
    assert decide_verdict(srm, tests, None, "m").first()["verdict"] == v.NO_EFFECT


def test_clean_experiment_is_safe(balanced):
    tables = analyze(balanced, primary_metric="revenue", row_id="user_id", bootstrap_samples=100)
    assert tables["verdict"].first()["verdict"] == v.SAFE
    assert {r["metric"] for r in tables["metric_tests"].collect()} == {"revenue", "converted"}
    assert {r["metric"] for r in tables["psm"].collect()} == {"revenue", "converted"}
    assert set(tables) == {"srm", "srm_levels", "metric_tests", "psm", "balance", "sensitivity",
                           "verdict", "roles"}


def test_uneven_split_is_compromised_but_everything_is_computed(uneven):
    tables = analyze(uneven, covariates=["tier"], bootstrap_samples=20)
    row = tables["verdict"].first()
    assert row["verdict"] == v.COMPROMISED and "not split as planned" in row["reasons"][0]
    assert tables["psm"].count() == 1 and tables["metric_tests"].count() == 1


def test_confounded_effect_is_compromised(confounded):
    n = confounded.count()
    share = confounded.where("variant = 'treatment'").count() / n
    tables = analyze(confounded, expected_ratio={"control": 1 - share, "treatment": share},
                     primary_metric="revenue", bootstrap_samples=100, row_id="user_id")
    assert tables["verdict"].first()["rule"] in (2, 3)


def test_cuped_replaces_the_primary(balanced):
    tables = analyze(balanced, primary_metric="revenue", cuped="pre_value", bootstrap_samples=20)
    assert tables["cuped"].first()["variance_reduction"] > 0
    metrics = {r["metric"] for r in tables["metric_tests"].collect()}
    assert metrics == {"revenue__cuped", "converted"}
    assert {r["metric"] for r in tables["psm"].collect()} == {"converted"}
    assert tables["roles"].first()["covariates"] == ["device"]


def test_roles_given_in_full_need_no_profile(balanced, monkeypatch):
    import fairsplit.plans.analyze as module
    monkeypatch.setattr(module, "profile_table", lambda df: pytest.fail("profiled"))
    tables = analyze(balanced, variant_column="variant", control_label="control",
                     treatment_label="treatment", primary_metric="converted",
                     secondary_metrics=[], covariates=[], correction="none")
    assert "psm" not in tables
    assert tables["metric_tests"].first()["adjusted_p_value"] is None


def test_numeric_arm_labels(balanced):
    coded = balanced.withColumn("variant", F.when(F.col("variant") == "control", 1).otherwise(2))
    tables = analyze(coded, primary_metric="revenue", covariates=[])
    assert tables["srm"].first()["n"] == 5_000
    assert tables["verdict"].first()["verdict"] == v.SAFE


def test_bad_calls(balanced):
    with pytest.raises(StatisticsError, match="instead of 1"):
        analyze(balanced, expected_ratio={"control": 0.2, "treatment": 0.2})
    with pytest.raises(RoutingError, match="CUPED"):
        analyze(balanced, cuped="absent")
    with pytest.raises(RoutingError, match="not in the table"):
        analyze(balanced, variant_column="absent")


def test_file_to_verdict(spark, balanced, tmp_path):
    path = str(tmp_path / "experiment")
    balanced.write.csv(path, header=True)
    loaded = load_experiment_csv(spark, path)
    tables = analyze(loaded.data, profile=loaded.profile, quality=loaded.quality, covariates=[])
    assert tables["verdict"].first()["verdict"] == v.SAFE
    assert not tables["quality"].first()["has_issues"]
