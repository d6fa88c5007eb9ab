"""The network's slope against finite differences, its pooling against loops, and held-out quality."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairsplit.llm import quality
from fairsplit.llm.common import remainder, table as given
from llm_documents import prose, table


def plain(net: quality.Network, text: bytes) -> float:
    """Probability of one text by loops over its windows."""
    size = quality.WINDOWS + quality.WIDTH - 1
    text = text.ljust(size, b"\0")
    starts = list(range(0, len(text) - size, quality.WINDOWS)) + [len(text) - size]
    chunks = []
    for start in starts:
        windows = [text[start + i:start + i + quality.WIDTH] for i in range(quality.WINDOWS)]
        chunks.append(np.max([sum(net.vectors[b] @ net.filters[k] for k, b in enumerate(w)) for w in windows], axis=0))
    h = np.tanh(np.array(chunks) + net.offsets)
    z = np.append(h.mean(axis=0), h.max(axis=0)) @ net.weights + net.bias[0]
    return 1 / (1 + np.exp(-z))


def some_texts():
    draw = random.Random(1)
    return [prose(draw, n).encode() for n in (0, 1, 20, 26, 27, 60, 200)] + ["Ümläut ß 漢字".encode() * 30]


def test_pooling_against_loops():
    net, texts = quality.Network.fresh(3), some_texts()
    want = [plain(net, t) for t in texts]
    assert quality.probabilities(net, texts) == pytest.approx(want, abs=1e-5)
    assert [quality.probabilities(net, [t])[0] for t in texts] == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("size", [0, 1, 261, 262, 516, 517, 518, 5000])
def test_chunks_cover_every_window(size):
    start, _ = quality.chunks([b"x" * size])
    seen = {s + i for s in start.tolist() for i in range(quality.WINDOWS)}
    assert seen == set(range(max(size, quality.WINDOWS + quality.WIDTH - 1) - quality.WIDTH + 1))


def test_slope_against_finite_differences(monkeypatch):
    net, texts = quality.Network.fresh(5), some_texts()
    good = np.arange(len(texts)) % 2.0
    monkeypatch.setattr(quality.Network, "tables", lambda self: np.einsum("bv,kvf->kbf", self.vectors, self.filters))
    _, slope = quality.gradient(net, texts, good)
    flat, draw = net.flat(), np.random.default_rng(2)
    strongest = np.argsort(-np.abs(slope))[:60]
    for i in np.append(strongest, draw.integers(0, len(flat), 60)):
        ends = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-3
            ends.append(quality.gradient(quality.Network.of(moved), texts, good)[0])
        assert slope[i] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=2e-4)


def test_held_out_rows(spark):
    docs, labels = (given(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = quality.learn(docs, labels, remainder("doc_id", 5) != 0)
    got = quality.score(docs, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0)
    row = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("predicted"))).alias("kept"),
                  F.avg(F.when(F.col("quality") == 0, F.col("predicted"))).alias("missed")).first()
    assert row.kept > 0.97 and row.missed < 0.2


def test_defined_cases(spark):
    draw = random.Random(2)
    texts = [prose(draw, 30) if i % 3 else "!! ".join(prose(draw, 30).upper().split()) for i in range(240)]
    docs = table(spark, [*enumerate(texts), (240, None), (241, ""), (None, texts[1]), (5, texts[5]), (242, texts[1] * 500)],
                 ("score", "good", "part"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(200)] + [(None, 0, 1), (3, None, 0), (4, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 245
    told = {r.doc_id: r for r in got}
    assert np.mean([told[i].predicted == (i % 3 > 0) for i in range(200, 240)]) > 0.95
    assert told[None].score == pytest.approx(told[1].score) and told[240].score == pytest.approx(told[241].score)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    again = quality.learn(docs.repartition(7), labels.repartition(3), F.lit(True))
    assert (again.net.flat() == model.net.flat()).all()


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(0, 1), (1, 1)], 2.5 / 3), ([(0, 0)], 0.25), ([(7, None)], 0.5)])
def test_without_both_classes(spark, labels, want):
    docs = table(spark, ["some words", None, "more"])
    judged = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learn(docs, judged, F.lit(True))
    assert [r.score for r in quality.score(docs, model).collect()] == pytest.approx([want] * 3)
