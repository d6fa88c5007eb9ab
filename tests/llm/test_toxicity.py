"""Held-out quality of the positive-unlabelled classifier and its risk."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairsplit.llm import toxicity
from fairsplit.llm.common import remainder, table as given
from llm_documents import prose, table


def test_held_out_rows(spark):
    docs, labels = (given(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels, remainder("doc_id", 5) != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0)
    row = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"),
                  F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert row.found > 0.85 and row.wrong < 0.02


def test_unlabelled_positives_do_not_hide_the_class():
    """Half of all positives are among the unlabelled, and the classifier still tells them."""
    draw = np.random.default_rng(1)
    positive = [np.unique(np.append(draw.integers(2, 40, 5), 0)) for _ in range(300)]
    negative = [np.unique(draw.integers(2, 40, 5)) for _ in range(700)]
    weights, bias = toxicity.fit(positive[:150], positive[150:] + negative, 40, 150 / 850)
    scores = [weights[x].sum() + bias for x in positive[150:] + negative]
    assert np.mean([s > 0 for s in scores[:150]]) > 0.95 and np.mean([s > 0 for s in scores[150:]]) < 0.05


def test_defined_cases(spark):
    draw = random.Random(2)
    texts = [prose(draw, 20) + (" zorkish zorkling zorkete" if i % 4 == 0 else "") for i in range(200)]
    docs = table(spark, [*enumerate(texts), (200, None), (201, ""), (None, "zorkish zorkling zorkete"), (5, texts[5])],
                 ("score", "positive", "predicted"))
    labels = spark.createDataFrame([(i, None, int(i % 4 == 0)) for i in range(0, 200, 2)] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 204
    told = {r.doc_id: r.predicted for r in got}
    assert all(told[i] == (i % 4 == 0) for i in range(200)) and told[200] == told[201] == 0 and told[None] == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_positives(spark):
    docs = table(spark, ["some words", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


@pytest.mark.parametrize("text", ["", " ", "!!", "a", "ab", "Ümläut straße", "x" * 5000])
def test_runs_stay_within_words(text):
    buckets, words = toxicity.runs(text)
    assert len(buckets) == len(words)
    joined = toxicity.runs(text + " " + text)[0]
    assert set(joined.tolist()) == set(buckets.tolist())


def plain_risk(w, b, positives, unlabelled, prior):
    """Positive part, negative part and their slopes, by a dense loop."""
    def dense(rows):
        x = np.zeros((len(rows), len(w)))
        for i, r in enumerate(rows):
            x[i, r] = 1
        return x
    def mean_loss(x, sign):
        return np.mean(np.log1p(np.exp(-sign * (x @ w + b))))
    p, u = dense(positives), dense(unlabelled)
    return prior * mean_loss(p, 1), mean_loss(u, -1) - prior * mean_loss(p, -1)


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_slope_against_finite_differences_of_the_dense_risk(prior):
    draw = np.random.default_rng(4)
    rows = [np.unique([*draw.integers(0, 12, 4), *[12] * (i < 20)]) for i in range(60)]
    positives, unlabelled = rows[:20], rows[20:]
    at, row = np.concatenate(rows), np.repeat(np.arange(60), [len(r) for r in rows])
    signs = set()
    for shift in (-2.0, 0.0, 2.0):
        w, b = np.append(draw.normal(0, 1, 12), 6.0), shift
        positive, negative, slope = toxicity.risk_parts(w, b, at, row, np.arange(60) < 20, prior)
        assert (positive, negative) == pytest.approx(plain_risk(w, b, positives, unlabelled, prior))
        signs.add(negative >= 0)
        got = np.append(np.bincount(at, slope[row], 13), slope.sum())
        for i in range(14):
            ends = []
            for sign in (1, -1):
                moved = np.append(w, b)
                moved[i] += sign * 1e-5
                up, down = plain_risk(moved[:-1], moved[-1], positives, unlabelled, prior)
                ends.append(up + down if negative >= 0 else -down)
            assert got[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)
    assert prior < 0.5 or False in signs


def test_counts_equal_sets_of_features(spark):
    draw = random.Random(8)
    texts = [prose(draw, 12) for _ in range(60)]
    held = [set(toxicity.levels(*toxicity.runs(t)).tolist()) for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["bucket"]: r["n"] for r in toxicity._counted(rows, None).collect()}
    want = {f: sum(f in h for h in held) for f in set().union(*held)}
    assert got == want | {toxicity.TOTAL: 60}


@pytest.mark.parametrize("richer", [1, 2, 4])
def test_judged_rows_richer_than_the_corpus(spark, richer):
    """An eighth of all documents is toxic; of the judged ones one, two or four times as many."""
    draw = random.Random(9)
    texts = [prose(draw, 20) + (" zorkish zorkling zorkete" if i % 8 == 0 else "") for i in range(640)]
    toxic = [i for i in range(0, 320) if i % 8 == 0]
    clean = [i for i in range(0, 320) if i % 8][:len(toxic) * (8 - richer) // richer]
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in toxic + clean], "doc_id long, toxic int")
    model = toxicity.learn(table(spark, texts), labels, F.lit(True))
    told = {r.doc_id: r for r in toxicity.score(table(spark, [*texts, ""]), model).collect()}
    assert all(told[i].predicted == (i % 8 == 0) for i in range(640)) and told[640].score < 0.3


def test_prior_is_bounded_by_what_all_text_shows():
    assert toxicity.bounded_prior(0.5, [(0.2, 1.0), (0.3, 1.0)], 100) == pytest.approx(0.2)
    assert toxicity.bounded_prior(0.1, [(0.2, 1.0)], 100) == 0.1
    assert toxicity.bounded_prior(0.5, [(0.001, 0.02)], 100) == 0.5  # two positives of a hundred prove nothing
