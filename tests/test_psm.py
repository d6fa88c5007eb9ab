"""The composite matching analysis."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairsplit import StatisticsError, propensity_score_match
from fairsplit.operators.design import design_matrix, find_levels, standardise

from fairsplit.functions.tails import normal_tail
from test_matching import brute_match, newton_logistic

ARMS = ("variant", "control", "treatment")


def test_shrinks_a_confounded_effect(confounded):
    t = propensity_score_match(confounded, "revenue", *ARMS, ["pre_value"], bootstrap_samples=200)
    r = t.result.first()
    assert r["naive_effect"] > 0
    assert abs(r["psm_att"]) < 0.6 * abs(r["naive_effect"])
    assert r["psm_ci_low"] < r["psm_ci_high"]
    assert r["psm_se_bootstrap"] > 0 and r["psm_se_paired_t"] > 0
    assert r["trimmed_treated"] >= 0 and r["bootstrap_resamples"] == 200
    b = t.balance.first()
    assert abs(b["smd_after"]) < abs(b["smd_before"])


def test_against_a_numpy_run(confounded):
    t = propensity_score_match(confounded, "revenue", *ARMS, ["pre_value"], bootstrap_samples=100,
                               row_id="user_id", rows_per_bucket=400)
    r = t.result.first()
    p = confounded.toPandas()
    treated = (p.variant == "treatment").to_numpy().astype(int)
    x = p[["pre_value"]].to_numpy(float)
    scaled = (x - x.mean(0)) / x.std(0)
    w = newton_logistic(scaled, treated)
    score = 1 / (1 + np.exp(-(w[0] + scaled @ w[1:])))
    inside = (score >= score[treated == 1].min()) & (score <= score[treated == 0].max())
    assert r["trimmed_treated"] == (treated[~inside] == 1).sum()
    assert r["trimmed_control"] == (treated[~inside] == 0).sum()
    logit = np.log(score / (1 - score))
    caliper = 0.2 * logit[inside].std(ddof=1)
    assert r["caliper"] == pytest.approx(caliper, rel=1e-6)
    kept = pd.DataFrame({"_row_id": p.user_id, "treated": treated, "logit": logit})[inside]
    match = brute_match(kept, caliper)
    y = p.set_index("user_id")["revenue"]
    diffs = np.array([y[u] - y[c] for u, c in match.items()])
    assert r["n_matched_pairs"] == len(diffs)
    assert r["psm_att"] == pytest.approx(diffs.mean(), rel=1e-6)
    assert r["psm_se_paired_t"] == pytest.approx(diffs.std(ddof=1) / math.sqrt(len(diffs)), rel=1e-6)
    assert r["psm_se_bootstrap"] == pytest.approx(r["psm_se_paired_t"], rel=0.3)
    assert r["naive_effect"] == pytest.approx(
        p.revenue[treated == 1].mean() - p.revenue[treated == 0].mean(), rel=1e-9)
    curve = [row["upper_p"] for row in t.sensitivity.orderBy("gamma").collect()]
    # Without hidden bias this is the signed-rank test.
    ranks = pd.Series(np.abs(diffs[diffs != 0])).rank().to_numpy()
    up = ranks[diffs[diffs != 0] > 0].sum()
    z = (up - ranks.sum() / 2) / math.sqrt((ranks ** 2).sum() / 4)
    assert curve[0] == pytest.approx(min(1, 2 * max(normal_tail(z), 0)), rel=1e-6)
    assert curve == sorted(curve)
    pre = p.set_index("user_id")["pre_value"]
    a, b = pre.loc[list(match)].to_numpy(), pre.loc[list(match.values())].to_numpy()
    smd = (a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2)
    assert t.balance.first()["smd_after"] == pytest.approx(smd, rel=1e-5)


def test_categorical_covariate_and_bounds(balanced):
    t = propensity_score_match(balanced, "revenue", *ARMS, ["pre_value", "device"], bootstrap_samples=100)
    assert {r["covariate"] for r in t.balance.collect()} == {"pre_value", "device_mobile"}
    ps = [r["upper_p"] for r in t.sensitivity.orderBy("gamma").collect()]
    assert len(ps) == 7 and all(a <= b + 1e-9 for a, b in zip(ps, ps[1:]))


def test_uneven_arms_with_three_distinct_scores(uneven):
    r = propensity_score_match(uneven, "converted", *ARMS, ["tier"], bootstrap_samples=50,
                               row_id="user_id", hot_rows=100).result.first()
    again = propensity_score_match(uneven, "converted", *ARMS, ["tier"], bootstrap_samples=50,
                                   row_id="user_id").result.first()
    assert r["n_matched_pairs"] > 0
    for name, value in r.asDict().items():
        assert again[name] == (pytest.approx(value) if isinstance(value, float) else value)


def test_metrics_with_gaps_get_their_own_match(balanced):
    holes = balanced.withColumn("spend", F.when(F.col("user_id") % 5 > 0, F.col("revenue")))
    both = propensity_score_match(holes, ["revenue", "spend", "converted"], *ARMS, ["pre_value"],
                                  bootstrap_samples=20, row_id="user_id")
    rows = {r["metric"]: r for r in both.result.collect()}
    assert list(rows) == ["revenue", "spend", "converted"]
    alone = propensity_score_match(holes, "spend", *ARMS, ["pre_value"], bootstrap_samples=20,
                                   row_id="user_id").result.first()
    assert rows["spend"]["n_treated"] < rows["revenue"]["n_treated"]
    for name in ("psm_att", "psm_se_bootstrap", "n_matched_pairs", "naive_effect", "caliper"):
        assert rows["spend"][name] == pytest.approx(alone[name], rel=1e-9)


def test_preconditions(balanced):
    with pytest.raises(StatisticsError, match="at least one covariate"):
        propensity_score_match(balanced, "revenue", *ARMS, [])
    with pytest.raises(StatisticsError, match="metric 'nope' not in DataFrame"):
        propensity_score_match(balanced, "nope", *ARMS, ["pre_value"])
    with pytest.raises(StatisticsError, match="covariate 'nope' not in DataFrame"):
        propensity_score_match(balanced, "revenue", *ARMS, ["nope"])
    with pytest.raises(StatisticsError, match="both arms"):
        propensity_score_match(balanced, "revenue", "variant", "control", "absent", ["pre_value"])


def test_separated_arms_do_not_overlap(spark):
    df = spark.createDataFrame([("control", float(i), 1.0) for i in range(100)]
                               + [("treatment", 1000.0 + i, 2.0) for i in range(100)],
                               "variant string, x double, y double")
    with pytest.raises(StatisticsError, match="overlap|one arm"):
        propensity_score_match(df, "y", *ARMS, ["x"])


def test_too_many_levels_is_an_error(balanced):
    wide = balanced.withColumn("name", F.col("user_id").cast("string"))
    with pytest.raises(StatisticsError, match="levels"):
        propensity_score_match(wide, "revenue", *ARMS, ["name"], max_levels=256)
    with pytest.raises(StatisticsError, match="levels"):
        find_levels(wide.where("user_id < 12"), ["name"], max_levels=10)


def test_design_matrix(spark):
    df = spark.createDataFrame([(1, "b", True, 2), (2, "a", False, 3), (3, "c", True, 4)],
                               "id int, kind string, flag boolean, n int")
    rows = design_matrix(df, ["kind", "flag", "n"], ["id"]).orderBy("id")
    assert rows.columns == ["id", "kind_b", "kind_c", "flag", "n"]
    assert [tuple(r) for r in rows.collect()] == [
        (1, 1.0, 0.0, 1.0, 2.0), (2, 0.0, 0.0, 0.0, 3.0), (3, 0.0, 1.0, 1.0, 4.0)]


def test_standardise_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, c double")
    got = standardise(df, ["x", "c"]).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(np.sort(got["x"]), (x - x.mean()) / x.std())
    assert (got["c"] == 0).all()


def test_text_ids_match_like_numbers_and_repeats_are_refused(confounded):
    options = dict(bootstrap_samples=40)
    text = confounded.withColumn("name", F.format_string("u%09d", "user_id"))
    one = propensity_score_match(text, "revenue", *ARMS, ["pre_value"], row_id="user_id", **options).result.first()
    two = propensity_score_match(text.repartition(7), "revenue", *ARMS, ["pre_value"], row_id="name",
                                 **options).result.first()
    assert (one["psm_att"], one["n_matched_pairs"]) == (pytest.approx(two["psm_att"], rel=1e-9), two["n_matched_pairs"])
    with pytest.raises(StatisticsError, match="tell units apart"):
        propensity_score_match(text.withColumn("name", F.lit("same")), "revenue", *ARMS, ["pre_value"], row_id="name")


def test_a_finished_match_leaves_no_folder(spark, confounded):
    from fairsplit.plans.storage import scratch_root
    before = set(os.listdir(scratch_root(spark))) if os.path.isdir(scratch_root(spark)) else set()
    t = propensity_score_match(confounded, "revenue", *ARMS, ["pre_value"], bootstrap_samples=20)
    assert set(os.listdir(scratch_root(spark))) == before and t.result.count() == 1
