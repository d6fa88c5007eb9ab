"""Covariates with any number of levels: sparse designs, and models whose levels stay in tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairsplit import StatisticsError, propensity_score_match
from fairsplit.operators import design, levels, logistic
from fairsplit.operators.levels import Levels, sparse_design
from fairsplit.operators.logistic import Block, fit, fit_groups
from test_matching import newton_logistic

ARMS = ("variant", "control", "treatment")


def dummies(values) -> tuple[np.ndarray, list]:
    """One column per level but the first in sorted order."""
    found = sorted(set(values))
    return np.array([[float(v == x) for x in found[1:]] for v in values]).reshape(len(values), -1), found


def units(n: int, sizes: list[int], seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({"x": np.round(rng.normal(0, 1, n), 3)})
    z = 0.7 * p.x
    for i, size in enumerate(sizes):
        # A third of all rows share one level.
        level = np.where(rng.random(n) < 0.33, 0, rng.integers(0, size, n))
        p[f"c{i}"] = [f"L{v:05d}" for v in level]
        z = z + rng.normal(0, 1, size)[level]
    p["treated"] = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    return p


def fitted(spark, p: pd.DataFrame, names: list[str]):
    rows = spark.createDataFrame(p).repartition(5)
    blocks = []
    for name in names:
        found = Levels.of(rows, F.col(name))
        rows = found.number(rows, F.col(name), f"w_{name}")
        blocks.append(Block(f"w_{name}", found.table.select("k", "n"), found.size, found.total, found.largest))
    mean, scale = p.x.mean(), p.x.std(ddof=0)
    got = fit(rows, "treated", [(F.col("x") - mean) / scale], blocks)
    betas = [{r["k"]: r["beta"] for r in t.collect()} for t in got.blocks]
    return got, betas, (p.x - mean) / scale


@pytest.mark.parametrize("sizes, broadcast", [([300], True), ([300], False), ([120, 90], True), ([2], True)])
def test_level_weights_are_those_of_a_dense_fit(spark, monkeypatch, sizes, broadcast):
    if not broadcast:
        monkeypatch.setattr(logistic, "BROADCAST_LEVELS", 0)
        monkeypatch.setattr(levels, "BROADCAST_LEVELS", 0)
    p = units(3_000, sizes)
    names = [f"c{i}" for i in range(len(sizes))]
    got, betas, x = fitted(spark, p, names)
    parts, found = zip(*(dummies(p[c]) for c in names))
    raw = np.hstack(parts)
    dense = np.column_stack([x, (raw - raw.mean(0)) / raw.std(0)])
    w = newton_logistic(dense, p.treated.to_numpy())
    want = w[2:] / raw.std(0)
    have = [b[k] for b, f in zip(betas, found) for k in range(1, len(f))]
    assert have == pytest.approx(want.tolist(), abs=2e-6)
    assert got.weights == pytest.approx([w[1]], abs=1e-6)
    assert got.intercept == pytest.approx(w[0] - (w[2:] * raw.mean(0) / raw.std(0)).sum(), abs=1e-5)


def test_no_level_reaches_the_driver_and_few_passes_do(spark):
    got, _, _ = fitted(spark, units(2_000, [400]), ["c0"])
    assert got.passes <= 12


def test_levels_are_numbered_in_order(spark):
    values = [f"{i * 7919 % 1000:03d}" for i in range(1000)] * 2 + ["500"] * 500 + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    found = Levels.of(rows, F.col("v"))
    assert (found.size, found.total, found.largest) == (1000, 2500, 502)
    assert [(r["k"], r["level"]) for r in found.table.orderBy("k").collect()] == list(enumerate(sorted({v for v in values if v})))
    numbered = found.number(rows, F.col("v"), "k")
    assert numbered.where("v IS NULL AND k IS NULL").count() == 5 and numbered.count() == len(values)
    assert numbered.where("v IS NOT NULL AND k != cast(v AS int)").count() == 0


def test_sparse_design(spark):
    df = spark.createDataFrame([(1, "b", True, 2.0), (2, "a", False, 0.0), (3, "c", True, 4.0), (4, None, True, 1.0),
                                (5, "b", True, None)], "id int, kind string, flag boolean, n double")
    rows, features = sparse_design(df, ["n", "kind", "flag"], ["id"])
    assert {r["index"]: r["feature"] for r in features.collect()} == {0: "n", 1: "kind_b", 2: "kind_c", 3: "flag"}
    assert {r["id"]: (r["indices"], r["values"]) for r in rows.collect()} == {
        1: ([0, 1, 3], [2.0, 1.0, 1.0]), 2: ([0, 3], [0.0, 0.0]), 3: ([0, 2, 3], [4.0, 1.0, 1.0]), 4: (None, None), 5: (None, None)}
    with pytest.raises(StatisticsError):
        sparse_design(df.withColumn("values", F.lit(1)), ["n"], ["values"])


def test_sparse_rows_equal_the_dense_design(spark):
    p = units(500, [30])
    df = spark.createDataFrame(p.assign(id=range(len(p))))
    rows, features = sparse_design(df, ["x", "c0"], ["id"])
    names = {r["index"]: r["feature"] for r in features.collect()}
    dense = design.design_matrix(df, ["x", "c0"], ["id"]).toPandas().set_index("id")
    assert sorted(names.values()) == sorted(dense.columns)
    for r in rows.collect():
        cells = {names[i]: v for i, v in zip(r["indices"], r["values"])}
        assert cells == {c: v for c, v in dense.loc[r["id"]].items() if v or c == "x"}


def test_match_over_a_wide_covariate_equals_the_dense_one(spark, balanced, monkeypatch):
    named = balanced.withColumn("shop", F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")))
    options = dict(bootstrap_samples=20, row_id="user_id")
    dense = propensity_score_match(named, ["revenue", "converted"], *ARMS, ["pre_value", "shop"], **options)
    monkeypatch.setattr(design, "MAX_LEVELS", 5)
    monkeypatch.setattr(design.wide_covariates, "__defaults__", (5,))
    wide = propensity_score_match(named, ["revenue", "converted"], *ARMS, ["pre_value", "shop"], **options)
    for a, b in zip(dense.result.collect(), wide.result.collect()):
        for name, value in a.asDict().items():
            assert b[name] == (pytest.approx(value, rel=1e-6) if isinstance(value, float) else value)
    before, after = ({(r["metric"], r["covariate"]): (r["smd_before"], r["smd_after"]) for r in t.balance.collect()}
                     for t in (dense, wide))
    assert set(before) == set(after)
    for key, value in before.items():
        assert after[key] == pytest.approx(value, abs=1e-9)


def test_five_thousand_levels(balanced):
    named = balanced.withColumn("shop", (F.col("user_id") % 2_500).cast("string"))
    t = propensity_score_match(named, "revenue", *ARMS, ["pre_value", "shop"], bootstrap_samples=20, row_id="user_id")
    assert t.result.first()["n_matched_pairs"] > 0
    assert t.balance.count() > 1_000


def test_models_of_groups(spark):
    rng = np.random.default_rng(3)
    parts = []
    for g, (n, shift) in {"a": (4_000, 0.5), "b": (300, -1.0), None: (200, 0.0), "one": (50, 99.0)}.items():
        x, z = rng.normal(3, 2, n), rng.random(n)
        t = (rng.random(n) < 1 / (1 + np.exp(-(shift + 0.4 * x)))).astype(int)
        parts.append(pd.DataFrame({"g": g, "h": n % 7, "x": x, "z": z, "constant": 5.0, "treated": t}))
    p = pd.concat(parts)
    got = fit_groups(spark.createDataFrame(p, "g string, h long, x double, z double, constant double, treated long"),
                     "treated", [F.col("x"), F.col("z"), F.col("constant")], ["g", "h"])
    rows = {r["g"]: r for r in got.collect()}
    assert set(rows) == {"a", "b", None, "one"} and rows["one"]["weights"] is None and rows["one"]["intercept"] is None
    for part in parts[:3]:
        r = rows[part.g.iloc[0]]
        x = part[["x", "z", "constant"]].to_numpy()
        scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
        want = newton_logistic((x - x.mean(0)) / scale, part.treated.to_numpy())
        assert [r["intercept"], *r["weights"]] == pytest.approx(want.tolist(), abs=1e-6)
        assert r["n"] == len(part) and r["h"] == len(part) % 7


def test_group_plan_has_no_python_group(spark):
    """Groups meet as sums only: no task gets all rows of a group."""
    from conftest import plan_text
    rows = spark.createDataFrame([(1, 0.5, 0), (1, 0.7, 1)], "g int, x double, treated int")
    run, shape, names = logistic._totals(2, None, False)
    asked = rows.selectExpr("g * 1L AS g", "treated * 1D AS y", "array(0D, 0D) AS theta", "x AS x1")
    text = plan_text(asked.mapInArrow(run, shape).groupBy("g", "i").agg(*[F.sum(c) for c in names]))
    assert "partial_sum" in text and "FlatMapGroups" not in text


def test_no_rows_and_no_settling(spark, monkeypatch):
    rows = spark.createDataFrame([(0.5, 0), (0.7, 1), (0.1, 1)], "x double, treated int")
    with pytest.raises(StatisticsError, match="needs rows"):
        fit(rows.limit(0), "treated", [F.col("x")])
    monkeypatch.setattr(logistic, "MAX_PASSES", 1)
    with pytest.raises(StatisticsError, match="not settled"):
        fit(rows, "treated", [F.col("x")])
