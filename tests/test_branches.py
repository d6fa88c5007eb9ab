"""Branches of a job graph, and matches of metrics with different gaps."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from fairsplit.plans.branches import run_branches
from fairsplit.plans.psm import _same_gaps, propensity_score_match


def test_branches_run_at_once_and_inherit(spark):
    meet = threading.Barrier(2, timeout=60)
    spark.sparkContext.setLocalProperty("callers.property", "kept")

    def branch(n):
        def run():
            meet.wait()  # breaks if the other branch has not started
            prop = spark.sparkContext.getLocalProperty
            return spark.range(n).count(), prop("callers.property"), prop("spark.scheduler.pool")
        return run

    got = run_branches(spark, {"a": branch(3), "b": branch(5)})
    assert [got[k][:2] for k in ("a", "b")] == [(3, "kept"), (5, "kept")]
    assert got["a"][2].startswith("a-") and got["b"][2].startswith("b-")
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    spark.sparkContext.setLocalProperty("callers.property", None)


def test_first_failure_is_raised_after_all_have_ended(spark):
    ended = []

    def fail(name):
        def run():
            ended.append(name)
            raise ValueError(name)
        return run

    with pytest.raises(ValueError, match="second"):
        run_branches(spark, {"first": lambda: ended.append("first"), "second": fail("second"), "third": fail("third")})
    assert sorted(ended) == ["first", "second", "third"]
    assert run_branches(spark, {}) == {}


def units(spark):
    """Orders as units; two metrics lack the same rows, one lacks others."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    treated = F.xxhash64("o_orderkey") % 1000 < F.col("o_totalprice") / 400 - 300
    y = F.col("o_totalprice") / 100 + F.when(treated, 50).otherwise(0) + F.col("o_orderkey") % 31
    return orders.select(
        F.col("o_orderkey").alias("id"), F.when(treated, "t").otherwise("c").alias("arm"),
        F.col("o_totalprice").alias("x"), y.alias("full"),
        F.when(F.col("o_orderkey") % 5 != 0, y * 2).alias("gap_a"), F.when(F.col("o_orderkey") % 5 != 0, -y).alias("gap_b"),
        F.when(F.col("o_orderkey") % 3 != 0, y + 1).alias("other"))


def test_gaps_match_as_each_metric_alone(spark):
    df = units(spark)
    metrics = ["gap_a", "other", "full", "gap_b"]

    def match(names):
        found = propensity_score_match(df, names, "arm", "c", "t", ["x"], row_id="id", bootstrap_samples=20)
        return {r["metric"]: r.asDict() for r in found.result.collect()}, \
            sorted(map(tuple, found.sensitivity.collect())), sorted(map(tuple, found.balance.collect()))

    together, sensitivity, shown = match(metrics)
    assert list(together) == metrics
    assert together["gap_a"]["n_treated"] == together["gap_b"]["n_treated"] != together["other"]["n_treated"]
    for m in ("other", "gap_b"):
        alone, curve, balance = match([m])
        for name, value in alone[m].items():
            assert together[m][name] == (pytest.approx(value) if isinstance(value, float) else value), name
        # Sums over tasks differ in their last digits.
        for one, every in ((curve, sensitivity), (balance, shown)):
            own = [row for row in every if row[0] == m]
            assert [row[:1] for row in own] == [row[:1] for row in one]
            assert [v for row in own for v in row if isinstance(v, float)] == pytest.approx(
                [v for row in one for v in row if isinstance(v, float)], abs=1e-9)


def test_equal_gap_counts_in_different_rows_stay_apart():
    counts = {"g_a_a": 4, "g_b_b": 4, "g_a_b": 0, "g_c_c": 0, "g_a_c": 0, "g_b_c": 0, "g_d_d": 4, "g_a_d": 4,
              "g_b_d": 0, "g_c_d": 0}
    assert _same_gaps(list("abcd"), {m: m for m in "abcd"}, counts) == [["c"], ["a", "d"], ["b"]]
