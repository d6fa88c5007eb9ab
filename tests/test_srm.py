"""Allocation test."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fairsplit import StatisticsError, srm_check
from fairsplit.operators.srm import plans_from_json, srm_by_plan, srm_from_counts


def test_fair_split_passes(balanced):
    found = srm_check(balanced, "variant").summary.first()
    assert not found["srm_detected"]
    assert found["p_value"] > 0.01
    assert found["df"] == 1


def test_uneven_split_is_detected(uneven):
    tables = srm_check(uneven, "variant")
    found = tables.summary.first()
    assert found["srm_detected"] and found["p_value"] < 1e-6
    levels = {r["level"]: r for r in tables.levels.collect()}
    assert levels["control"]["observed_ratio"] == pytest.approx(0.4, abs=0.03)
    assert levels["treatment"]["expected_ratio"] == 0.5


def test_planned_ratio_explains_the_split(uneven):
    found = srm_check(uneven, "variant", {"control": 0.4, "treatment": 0.6}).summary.first()
    assert not found["srm_detected"]


def test_statistic_by_hand(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20 + [(None,)] * 9,
                                 "variant string")
    planned = srm_check(rows, "variant", {"a": 0.5, "b": 0.25, "c": 0.25}).summary.first()
    assert planned["n"] == 100
    assert planned["chi2"] == pytest.approx(25 / 25 + 25 / 25)
    uniform = srm_check(rows, "variant").summary.first()
    e = 100 / 3
    assert uniform["chi2"] == pytest.approx(sum((o - e) ** 2 / e for o in (50, 30, 20)))
    assert uniform["df"] == 2


def test_numeric_labels_compare_as_text(spark):
    rows = spark.range(100).selectExpr("CAST(id % 2 + 1 AS INT) AS arm")
    assert srm_check(rows, "arm", {"1": 0.5, "2": 0.5}).summary.first()["chi2"] == 0


@pytest.mark.parametrize("ratio, message", [
    ({"a": 0.3, "b": 0.3}, "instead of 1"), ({"a": 0.5, "z": 0.5}, "other arms were observed"),
    ({"a": 0.5, "b": 0.25, "c": 0.25}, "other arms were observed")])
def test_bad_plans(spark, ratio, message):
    rows = spark.createDataFrame([("a",)] * 100 + [("b",)] * 100, "variant string")
    with pytest.raises(StatisticsError, match=message):
        srm_check(rows, "variant", ratio)


def test_absent_column(spark):
    with pytest.raises(StatisticsError, match="not in DataFrame"):
        srm_check(spark.range(5), "variant")


def test_single_level_and_no_level(spark):
    with pytest.raises(StatisticsError, match="single arm"):
        srm_check(spark.createDataFrame([("a",)] * 100, "variant string"), "variant")
    with pytest.raises(StatisticsError, match="no arm"):
        srm_check(spark.createDataFrame([(None,)] * 100, "variant string"), "variant")


def test_small_cells(spark):
    rows = spark.createDataFrame([("a",)] * 2 + [("b",)] * 3, "variant string")
    with pytest.raises(StatisticsError, match="fewer than 5 rows"):
        srm_check(rows, "variant")


def test_fleet_reports_issues_per_experiment(spark):
    rows = spark.createDataFrame(
        [("x", "a")] * 60 + [("x", "b")] * 40 + [("y", "a")] * 3 + [(None, "a")] * 50 + [(None, "b")] * 50,
        "experiment string, variant string")
    tables = srm_check(rows, "variant", by=["experiment"], on_issue="keep")
    found = {r["experiment"]: r for r in tables.summary.collect()}
    assert found["x"]["chi2"] == pytest.approx(4.0)
    assert "single arm" in found["y"]["issue"] and found["y"]["p_value"] is None
    assert found[None]["chi2"] == 0
    assert tables.levels.count() == 5


def test_many_arms_keep_a_p_value(spark):
    """One overfilled arm among 1,501 is found; the statistic is far beyond what an exponential can hold."""
    counts = spark.range(1501).select(F.col("id").cast("string").alias("level"),
                                      F.when(F.col("id") == 7, 200_000).otherwise(10_000).alias("observed"))
    row = srm_from_counts(counts, "arm").summary.first()
    assert row["srm_detected"] and row["p_value"] == 0 and row["issue"] is None
    assert row["split"].endswith("and 1493 more")


def test_split_is_named(spark):
    rows = spark.createDataFrame([("a",)] * 300 + [("b",)] * 100, "variant string")
    row = srm_check(rows, "variant", {"a": 0.5, "b": 0.5}).summary.first()
    assert row["split"] == "a 0.7500 (planned 0.5000), b 0.2500 (planned 0.5000)"


def test_first_arms_are_bounded(spark):
    """No list of all arms is formed; the reason has the first arms in name order and the number of the others."""
    counts = spark.range(300).selectExpr("CAST(id % 2 AS INT) AS e", "format_string('arm%03d', id) AS level",
                                         "10 + id AS observed")
    summary = srm_from_counts(counts, "arm", by=["e"]).summary
    for r in summary.collect():
        assert [x.split()[0] for x in r["split"].split(", ")] == [f"arm{2 * i + r['e']:03d}" for i in range(8)]
        assert r["split"].endswith(" and 142 more")
    whole = srm_from_counts(counts.drop("e"), "arm").summary
    assert whole.first()["split"].endswith(" and 292 more")
    for table in (summary, whole):
        assert "Limit" in table._jdf.queryExecution().optimizedPlan().toString()


def test_a_given_plan_needs_no_list_of_arms(spark):
    from conftest import plan_text
    counts = spark.createDataFrame([("x", "a", 300), ("x", "b", 100), ("y", "a", 5)], "e string, level string, observed long")
    text = plan_text(srm_from_counts(counts, "arm", {"a": 0.5, "b": 0.5}, by=["e"]).summary)
    assert "Window" not in text and "Join" not in text


def test_plans_of_their_own(spark):
    rows = [("x", "a")] * 60 + [("x", "b")] * 40 + [("y", "a")] * 90 + [("y", "c")] * 10 + [("none", "a")] * 50 + [("none", "b")] * 50
    rows += [("extra", "a")] * 50 + [("extra", "z")] * 50 + [("short", "a")] * 9 + [("short", "b")] * 9 + [(None, "a")] * 30 + [(None, "b")] * 70
    rows += [("sum", "a")] * 50 + [("sum", "b")] * 50 + [("tiny", "a")] * 100 + [("tiny", "b")] * 1 + [("x", None)] * 7
    plans = [("x", '{"a": 0.5, "b": 0.5}'), ("y", '{"a": 0.9, "c": 0.1}'), ("extra", '{"a": 0.5, "b": 0.5}'),
             ("short", '{"a": 0.5, "b": 0.25, "c": 0.25}'), (None, '{"b": 0.7, "a": 0.3}'), ("sum", '{"a": 0.5, "b": 0.4}'),
             ("tiny", '{"a": 0.99, "b": 0.01}'), ("unseen", '{"a": 1.0}'), ("none", "no json")]
    table = plans_from_json(spark.createDataFrame(plans, "e string, plan string"), ["e"])
    tables = srm_by_plan(spark.createDataFrame(rows, "e string, arm string"), "arm", table, ["e"])
    found = {r["e"]: r for r in tables.summary.collect()}
    assert set(found) == {"x", "y", "none", "extra", "short", "sum", "tiny", None}
    assert found["x"]["chi2"] == pytest.approx(4.0) and found["x"]["issue"] is None and found["x"]["n"] == 100
    assert found["y"]["chi2"] == pytest.approx(0.0, abs=1e-9) and found[None]["chi2"] == pytest.approx(0.0, abs=1e-9)
    wanted = {"none": "no plan", "extra": "not planned", "short": "absent", "sum": "instead of 1", "tiny": "fewer than 5 rows"}
    for name, text in wanted.items():
        assert text in found[name]["issue"] and found[name]["p_value"] is None and found[name]["chi2"] is None
    levels = {(r["e"], r["level"]): r for r in tables.levels.collect()}
    assert levels["x", "a"]["observed_ratio"] == pytest.approx(0.6) and levels["short", "c"]["observed"] is None


def test_repeated_or_empty_shares(spark):
    rows = spark.createDataFrame([("x", "a")] * 50 + [("x", "b")] * 50 + [("y", "a")] * 50 + [("y", "b")] * 50, "e string, arm string")
    plans = spark.createDataFrame([("x", "a", 0.25), ("x", "a", 0.25), ("x", "b", 0.5), ("y", "a", 1.0), ("y", "b", 0.0)],
                                  "e string, level string, share double")
    for r in srm_by_plan(rows, "arm", plans, ["e"]).summary.collect():
        assert "not positive" in r["issue"]
