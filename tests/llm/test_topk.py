"""Top-k search against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fairsplit.llm import topk


def brute(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * float(np.float32(c))) for c in v]
            vectors[i] = min(vectors.get(i, x), x, key=lambda y: np.array(y, "<i8").tobytes())
    out = set()
    for q, a in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("size,small", [(900, True), (60, False), (3, False)])
def test_against_all_pairs(spark, monkeypatch, size, small):
    draw = np.random.default_rng(size)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 12)]) for i in range(size)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1050, None), (1100, []), (1150, [0.5, None]),
             (1200, [float("nan")] * 12), (1250, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (1300, [0.7] * 5),
             (1350, [900.0, -3000.5] * 6), (1350, [900.0, -3000.5] * 6)]
    if small:
        monkeypatch.setattr(topk, "BLOCK", 32)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
        monkeypatch.setattr(topk, "GROUP", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as label", "'x' as code", "'x' as steps").repartition(3)
    got = topk.top_k(df).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(3)
    q, d = draw.integers(-90, 90, (7, 10)), draw.integers(-90, 90, (40, 10))
    bound = topk.bounds(q, d.min(axis=0)[None], d.max(axis=0)[None])[:, 0]
    assert (bound >= topk.scores(q, d).max(axis=1)).all()


def test_large_steps_stay_exact():
    q, d = np.array([[2**40, 3]], np.int64), np.array([[2**40, -5]], np.int64)
    assert int(topk.scores(q, d)[0, 0]) == 2**80 - 15
