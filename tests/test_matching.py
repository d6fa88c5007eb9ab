"""Matching steps against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from fairsplit.operators import matching, propensity
from fairsplit.operators.effects import (bootstrap_effects, bootstrap_summary, cell_draws, critical_gamma,
                                         digest_word, hash_cell, matched_effect, poisson_count,
                                         poisson_draws, rosenbaum_bounds, signed_rank_totals, unit_draws)
from fairsplit.plans.ordered import bucket_splits, midranks, with_buckets


def units(n=4_000, seed=1, decimals=2, gap=True):
    rng = np.random.default_rng(seed)
    logit = np.round(rng.normal(0, 1.2, n), decimals)
    logit[: n // 3] = 0.25  # a third of all units share one logit
    treated = (rng.random(n) < 0.5).astype(int)
    if gap:  # treated units far from any control
        treated[(logit > 1.0) & (logit < 2.0)] = 1
    order = rng.permutation(n)
    return pd.DataFrame({"_row_id": order, "treated": treated, "logit": logit,
                         "y": np.round(rng.normal(0, 1, n), 3)})


def brute_match(p, caliper):
    """Nearest control per treated unit; ties go up, then to the smallest id."""
    c = p[p.treated == 0].groupby("logit")["_row_id"].min()
    levels = c.index.to_numpy()
    out = {}
    for unit, logit in p.loc[p.treated == 1, ["_row_id", "logit"]].itertuples(index=False):
        up, down = levels[levels >= logit], levels[levels <= logit]
        best = None
        if len(up):
            best = (up[0] - logit, up[0])
        if len(down) and (best is None or logit - down[-1] < best[0]):
            best = (logit - down[-1], down[-1])
        if best is not None and best[0] <= caliper:
            out[unit] = c[best[1]]
    return out


@pytest.mark.parametrize("rows_per_bucket, hot_rows", [(10**9, 10**9), (60, 10**9), (60, 5), (500, 50)])
def test_match_equals_brute_force(spark, rows_per_bucket, hot_rows):
    p = units()
    df = spark.createDataFrame(p)
    splits = bucket_splits(df, ["logit"], len(p), rows_per_bucket)["logit"]
    assert (len(splits) >= 5) == (rows_per_bucket <= 500)
    nearest = matching.nearest_controls(df, splits, ["y"])
    caliper = 0.05
    counts = matching.match_counts(nearest, caliper)
    want = brute_match(p, caliper)
    assert counts["matched"] == len(want)
    assert counts["discarded"] == (p.treated == 1).sum() - len(want) > 0
    pairs = matching.matched_pairs(df, matching.within_caliper(nearest, caliper),
                                   counts["matched"], counts["largest"], hot_rows)
    got = pairs.toPandas()
    assert dict(zip(got._row_id, got.control_id)) == want
    assert len(got) == len(want)
    y = p.set_index("_row_id")["y"]
    assert np.allclose(got["c_y"], y.loc[got.control_id].to_numpy())


def test_buckets_without_controls(spark):
    """Controls only at both ends: the middle buckets look across."""
    p = pd.DataFrame({"_row_id": range(1_000), "treated": 1, "logit": np.arange(1_000) / 100.0, "y": 0.0})
    p.loc[[0, 999], "treated"] = 0
    df = spark.createDataFrame(p)
    splits = bucket_splits(df, ["logit"], 1_000, 50)["logit"]
    got = matching.nearest_controls(df, splits).toPandas().set_index("logit")["control_id"]
    assert (got[got.index < 4.99] == 0).all() and (got[got.index > 5.0] == 999).all()


def test_no_control_at_all(spark):
    df = spark.createDataFrame(pd.DataFrame({"_row_id": [1, 2], "treated": 1, "logit": [0.1, 0.2]}))
    counts = matching.match_counts(matching.nearest_controls(df, []), 1.0)
    assert counts == {"matched": 0, "discarded": 2, "largest": 0}


def test_match_plan_has_no_pairwise_join(spark):
    df = spark.createDataFrame(units())
    nearest = matching.nearest_controls(df, [-1.0, 0.0, 1.0], ["y"])
    text = plan_text(matching.matched_pairs(df, nearest, 100, 50, 5))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_single_partition_only_over_bucket_totals(spark):
    """Whatever is gathered in one task has been aggregated per bucket first."""
    df = spark.createDataFrame(units())
    rows = with_buckets(df, {"logit": [-1.0, 0.0, 1.0]}, {"logit": "bucket"}) \
        .withColumnRenamed("logit", "value")
    for plan in (plan_text(matching.nearest_controls(df, [-1.0, 0.0, 1.0])), plan_text(midranks(rows))):
        lines = plan.splitlines()
        singles = [i for i, line in enumerate(lines) if "SinglePartition" in line]
        assert singles
        for i in singles:
            below = "".join(lines[i + 1:i + 4])
            assert "HashAggregate(keys=[bucket#" in below and "value#" not in below.split("functions")[0]


@pytest.mark.parametrize("rows_per_bucket", [50, 10**9])
def test_midranks(spark, rows_per_bucket):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"g": rng.integers(0, 3, 2_000), "value": np.round(rng.normal(0, 2, 2_000), 1)})
    assert (np.signbit(p["value"]) & (p["value"] == 0)).any()  # negative zeros are among them
    df = spark.createDataFrame(p)
    splits = bucket_splits(df, ["value"], len(p), rows_per_bucket)
    got = midranks(with_buckets(df, splits, {"value": "bucket"}), ["g"]).toPandas()
    p["want"] = p.groupby("g")["value"].rank()
    merged = got.merge(p.drop_duplicates(), on=["g", "value"])
    assert len(merged) == len(got)
    assert (merged["midrank"] == merged["want"]).all()


# --- score --------------------------------------------------------------------------

def newton_logistic(x, t):
    """Half squared weights plus summed log loss, intercept free."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        w = w - np.linalg.solve(h, a.T @ (p - t) + penalty @ w)
    return w


@pytest.mark.parametrize("discrete", [False, True])
def test_model_is_the_penalised_optimum(spark, discrete):
    rng = np.random.default_rng(4)
    n = 3_000
    x = rng.normal(0, 1, (n, 2)) * [3.0, 0.2] + [10.0, -1.0]
    x = np.round(x) if discrete else x
    t = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 10) * 0.5))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"_row_id": range(n), "treated": t, "v0": x[:, 0], "v1": x[:, 1]}))
    mean, scale = x.mean(0), x.std(0)
    model = propensity.fit_propensity(df, [F.col("v0"), F.col("v1")], mean.tolist(), scale.tolist())
    want = newton_logistic((x - mean) / scale, t)
    assert [model.intercept, *model.weights] == pytest.approx(want.tolist(), abs=1e-6)


def test_support_keeps_the_documented_interval(spark):
    p = [0.1, 0.2, 0.3, 0.4, 0.6, 0.8]
    treated = [0, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(t, v, v) for t, v in zip(treated, p)], "treated int, p double, logit double")
    s = propensity.common_support(df)
    assert (s.low, s.high) == (0.3, 0.6)
    assert (s.treated, s.control, s.trimmed_treated, s.trimmed_control) == (1, 2, 1, 2)


def test_logit_is_clipped(spark):
    row = spark.range(1).select(propensity.logit(F.lit(0.0)), propensity.logit(F.lit(1.0))).first()
    assert row[0] == pytest.approx(-13.8155, abs=1e-3) and row[1] == pytest.approx(13.8155, abs=1e-3)


# --- resampling, hidden bias -------------------------------------------------------------

def test_weights_are_poisson_one(spark):
    df = spark.range(40_000).select(poisson_count(digest_word(F.col("id"), F.lit(3), 11)).alias("w"))
    digests = np.array([r["w"] for r in df.collect()])
    units = np.random.default_rng(3).integers(0, 2**63, 40_000, dtype=np.uint64)
    for w in (digests, poisson_draws(units, 3, 11)):
        assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)
        assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    other = poisson_draws(units, 4, 11)
    assert abs(np.corrcoef(poisson_draws(units, 3, 11), other)[0, 1]) < 0.02


def test_bootstrap_spread_matches_theory(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(0.5, 2.0, 2_000)
    pairs = spark.createDataFrame(pd.DataFrame({"_row_id": range(len(d)), "d": d})).repartition(3)
    drawn = bootstrap_effects(pairs, {"m": "d"}, 400)
    att = matched_effect(pairs, {"m": "d"}).select("metric", "psm_att")
    row = bootstrap_summary(drawn, att).first()
    se = d.std(ddof=1) / np.sqrt(len(d))
    assert row["resamples"] == 400
    assert row["psm_se_bootstrap"] == pytest.approx(se, rel=0.15)
    assert row["psm_ci_low"] == pytest.approx(d.mean() - 1.96 * se, abs=0.4 * se)
    values = np.array([r["att"] for r in drawn.collect()])
    assert row["psm_ci_high"] == pytest.approx(np.quantile(values, 0.975), rel=1e-9)
    assert row["psm_p_value"] == pytest.approx(min(1, 2 * (values <= 0).mean()))


def test_bootstrap_does_not_depend_on_partitions(spark):
    pairs = spark.range(500).select(F.col("id").alias("_row_id"), (F.col("id") % 7 - 2.5).alias("d"))
    runs = [bootstrap_effects(pairs.repartition(k), {"m": "d"}, 8, n_pairs=n).orderBy("resample")
            .toPandas()["att"].to_numpy() for k, n in ((1, None), (7, 500))]
    assert np.allclose(*runs, rtol=1e-12)


@pytest.mark.parametrize("n", [1, 700, 20_000])
def test_resamples_have_the_size_of_the_table_and_its_sums(spark, n):
    """Every resample against numpy on the same cells: whole counts that add up to the number of pairs."""
    rng = np.random.default_rng(8)
    d = rng.normal(1.0, 2.0, n)
    pairs = spark.createDataFrame(pd.DataFrame({"_row_id": range(n), "d": d}))
    bits, b, seed = max(0, int(np.ceil(np.log2(n / 4_096)))), 12, 5
    p = pairs.select(F.xxhash64("_row_id").alias("u"), "d").withColumn("cell", hash_cell(bits)).toPandas()
    sizes = np.bincount(p.cell, minlength=1 << bits)
    want, drawn = np.zeros(b), np.zeros(b, int)
    for cell, rows in p.sort_values(["cell", "u"]).groupby("cell"):
        for i, counts in enumerate(unit_draws(cell_draws(sizes, cell, b, seed), cell, len(rows), seed)):
            assert len(counts) == len(rows)
            want[i] += counts @ rows.d.to_numpy()
            drawn[i] += counts.sum()
    assert (drawn == n).all()
    got = bootstrap_effects(pairs, {"m": "d"}, b, seed, n_pairs=n).orderBy("resample").toPandas()["att"]
    assert np.allclose(got, want / n, rtol=1e-9)


def test_draws_split_like_a_multinomial():
    sizes = np.array([10, 0, 500, 90, 1, 0, 0, 399])
    draws = np.array([cell_draws(sizes, c, 4_000, 2) for c in range(8)])
    assert (draws.sum(axis=0) == 1_000).all() and not draws[[1, 5, 6]].any()
    share = sizes / 1_000
    assert np.allclose(draws.mean(axis=1), sizes, atol=0.8)
    assert np.allclose(draws.var(axis=1)[share > 0], (1_000 * share * (1 - share))[share > 0], rtol=0.12)
    assert np.cov(draws[2], draws[7])[0, 1] == pytest.approx(-1_000 * 0.5 * 0.399, rel=0.12)


def exact_bound(d, gamma):
    """Probability of so large a rank sum if every pair is positive with the worst odds ``gamma``: all sign
    patterns, added up rank by rank."""
    ranks = np.array([1 + sum(abs(x) < abs(y) for x in d) for y in d])
    worst = gamma / (1 + gamma)
    chance = np.zeros(ranks.sum() + 1)
    chance[0] = 1.0
    for k in ranks:
        moved = np.zeros_like(chance)
        moved[k:] = chance[:len(chance) - k]
        chance = (1 - worst) * chance + worst * moved
    return chance[ranks[np.array(d) > 0].sum():].sum()


def bounds_of(spark, d, rows_per_bucket=10**9):
    pairs = spark.createDataFrame(pd.DataFrame({"d": d}))
    splits = bucket_splits(pairs.select(F.abs("d").alias("d0")), ["d0"], len(d), rows_per_bucket)
    return rosenbaum_bounds(signed_rank_totals(pairs, {"m": "d"}, splits))


def test_rosenbaum_by_hand(spark):
    """Ranks 1 to 6, the second negative: the positive ones add up to 19 of 21."""
    got = {r["gamma"]: r["upper_p"] for r in bounds_of(spark, [0.5, -1.0, 1.5, 2.0, 4.0, 7.0]).collect()}
    assert got[1.0] == pytest.approx(0.0747, abs=2e-4)  # 8.5 / sqrt(91 / 4) = 1.782
    assert got[2.0] == pytest.approx(0.2662, abs=2e-4)  # 5 / sqrt(91 * 2 / 9) = 1.112


@pytest.mark.parametrize("rows_per_bucket", [60, 10**9])
def test_rosenbaum_against_all_sign_patterns(spark, rows_per_bucket):
    d = np.random.default_rng(10).normal(0.45, 1.0, 90)
    got = bounds_of(spark, d, rows_per_bucket)
    for row in got.collect():
        assert row["upper_p"] == pytest.approx(min(1, 2 * exact_bound(d, row["gamma"])), abs=0.02)
    curve = got.orderBy("gamma").toPandas()
    assert (np.diff(curve["upper_p"]) >= -1e-9).all()
    assert critical_gamma(got).first()["gamma_critical"] == curve.loc[curve["upper_p"] > 0.05, "gamma"].min()


def test_rosenbaum_ties_do_not_depend_on_buckets(spark):
    d = np.round(np.random.default_rng(11).normal(0.3, 1.0, 1_500), 1)
    one, many = (bounds_of(spark, d, n).orderBy("gamma").toPandas() for n in (10**9, 60))
    assert np.allclose(one["upper_p"], many["upper_p"], rtol=1e-9)


def test_rosenbaum_direction_and_few_pairs(spark):
    rng = np.random.default_rng(12)
    d = rng.normal(-0.5, 1.0, 400)
    pairs = spark.createDataFrame(pd.DataFrame({"d": d, "few": np.where(np.arange(400) < 4, 1.0, 0.0)}))
    upper = rosenbaum_bounds(signed_rank_totals(pairs, {"m": "d"})).orderBy("gamma").first()
    assert upper["upper_p"] == 1.0
    own = rosenbaum_bounds(signed_rank_totals(pairs, {"m": "d"}, direction={"m": -1})).orderBy("gamma").first()
    mirrored = rosenbaum_bounds(signed_rank_totals(pairs.withColumn("d", -F.col("d")), {"m": "d"}))
    assert own["upper_p"] == pytest.approx(mirrored.orderBy("gamma").first()["upper_p"], rel=1e-9)
    assert rosenbaum_bounds(signed_rank_totals(pairs, {"m": "few"})).count() == 0
