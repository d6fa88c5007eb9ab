"""Counts and base against plain Python; the model is a distribution and beats the base."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairsplit.llm import lm_score
from llm_documents import prose, table


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_against_plain_counts(spark):
    draw = random.Random(1)
    texts = [None, "", " \t", "A a\u00a0b", *(prose(draw, draw.randrange(1, 60)) for _ in range(60)), prose(draw, 9000)]
    rows = [*enumerate(texts), (None, texts[9]), (8, texts[8])]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    docs = table(spark, rows, ("held", "base", "chunk", "tokens")).repartition(4)
    got = sorted((tuple(r) for r in lm_score.score(docs, lm_score.held_out()).collect()), key=str)
    expected = []
    for i, x in rows:
        own = tokens(x)
        expected.append((i, held[i], len(own), sum(counts[t] > 0 for t in own), n,
                         sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)))
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=str)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    assert lm_score.score(docs.limit(0), lm_score.held_out()).count() == 0


def test_probabilities_add_up_to_one():
    draw = np.random.default_rng(3)
    model = lm_score.Model(np.empty(0, np.uint64), np.empty(0, np.int64),
                           draw.normal(size=(lm_score.ROWS, lm_score.CLASSES)).astype(np.float32),
                           draw.normal(size=(lm_score.ROWS, lm_score.CLASSES, lm_score.MEMBERS)).astype(np.float32))
    every = np.arange(lm_score.SYMBOLS)
    rows = np.repeat(lm_score.context(np.array([5, 9, 200, 7]), np.array([4]))[3:], len(every), axis=0)
    assert np.exp(lm_score.log_probabilities(model, every, rows)).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_descend():
    """A sequence that alternates is learned."""
    symbols = np.tile([3, 40], 3000)
    rows = lm_score.context(symbols, np.array([len(symbols)]))
    model = lm_score.Model(np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros((lm_score.ROWS, 16), np.float32),
                           np.zeros((lm_score.ROWS, 16, 16), np.float32))
    before = lm_score.log_probabilities(model, symbols, rows).mean()
    lm_score.gradient_steps(model, symbols, rows, 1)
    assert before == pytest.approx(-math.log(256)) and lm_score.log_probabilities(model, symbols, rows).mean() > -0.5


def test_model_beats_the_base_on_held_out_rows(spark):
    from fairsplit.llm.common import table as given
    got = lm_score.score(given(spark, "/root/testdata/sf0.01", "documents"), lm_score.held_out())
    row = got.where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert row.s > row.b


def test_rows_are_sorted_as_two_byte_numbers(monkeypatch):
    """The gradient of each touched row is the sum over its tokens; the sort has keys that a radix sort takes."""
    kinds, real = [], np.argsort
    monkeypatch.setattr(lm_score.np, "argsort", lambda x, *a, **b: kinds.append(x.dtype) or real(x, *a, **b))
    draw = np.random.default_rng(1)
    size = lm_score.ROWS * lm_score.CLASSES
    rows, slope = draw.integers(size - 40, size, (50, 5)), draw.normal(size=(50, 16))
    table, seen = np.zeros((size, 16)), np.zeros((size, 16))
    lm_score._descend(table, seen, rows, slope)
    gradient = np.zeros((size, 16))
    np.add.at(gradient, rows.ravel(), np.repeat(slope, 5, axis=0))
    assert np.allclose(seen, gradient ** 2) and np.allclose(table, -lm_score.RATE * gradient / (1 + np.abs(gradient)))
    assert kinds == [np.uint16]


def test_words_beyond_the_most_frequent_are_learned(spark):
    """Two thousand words that occur equally often, each always followed by the same one."""
    draw = random.Random(5)
    names = [f"w{i}x" for i in range(2000)]
    starts = [draw.randrange(2000) for _ in range(2500)]
    texts = [" ".join(names[(s + k) % 2000] for k in range(60)) for s in starts]
    row = (lm_score.score(table(spark, texts).coalesce(1), lm_score.held_out()).where("held_out")
           .agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"), F.sum("score").alias("s")).first())
    assert row.b / row.n < -3 and row.s / row.n > -2


def test_paths_of_all_words_add_up_to_one(spark):
    """Words with a path, the groups of all others, and within a group its words and one unseen word."""
    draw = random.Random(7)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 1000} r{draw.randrange(40_000)}" for _ in range(50))
             for _ in range(600)]
    counts = Counter(t for x in texts for t in tokens(x))
    hashes, n, others = lm_score.vocabulary(lm_score.word_counts(table(spark, texts)))
    assert len(counts) > len(hashes) > 255 and n.sum() + others.sum() == sum(counts.values())
    assert len(others) >= len(counts) / 16
    model = lm_score.start_model(hashes, n, others)
    ranks = np.arange(len(n) + len(others))
    assert sorted([*model.ranks, *model.groups]) == ranks.tolist()
    shares = np.exp(log_of_paths(model, ranks))
    expected = (np.concatenate([n, others]) + 0.5) / (n.sum() + others.sum() + len(ranks) / 2)
    assert shares[np.concatenate([model.ranks, model.groups])] == pytest.approx(expected, rel=1e-3)
    weights = np.random.default_rng(3)
    model.of_step = weights.normal(size=(1 << 10, 16)).astype(np.float32)
    model.of_class = weights.normal(size=model.of_class.shape).astype(np.float32)
    assert np.exp(log_of_paths(model, ranks)).sum() == pytest.approx(1, abs=1e-4)


def log_of_paths(model, ranks):
    """Of every path after the same two words."""
    model.of_step = np.zeros((1 << 10, 16), np.float32) if model.of_step is None else model.of_step
    texts = np.column_stack([np.zeros(len(ranks), np.int64), np.ones(len(ranks), np.int64), ranks]).ravel()
    words = np.where(np.arange(len(texts)) % 3 == 2, 0, texts + 1).astype(np.uint64) << np.uint64(32)
    return lm_score.path_log_probabilities(model, texts, words, np.full(len(ranks), 3))[2::3]


def test_frequent_words_have_short_paths():
    counts = np.sort((1e7 / np.arange(1, 100_001) ** 1.1).astype(np.int64))[::-1]
    tree, base = lm_score.tree_of(counts)
    ranks = np.arange(len(counts))
    depth = tree.depth(ranks)
    assert (np.diff(depth) >= 0).all() and tree.symbol(ranks).max() < lm_score.SYMBOLS
    begins, nodes, children = tree.steps(ranks)
    paths = {(s, *zip(nodes[a:b].tolist(), children[a:b].tolist()))
             for s, a, b in zip(tree.symbol(ranks).tolist(), begins[:-1].tolist(), begins[1:].tolist())}
    assert len(paths) == len(counts) and nodes.max() < len(base)
    assert np.average(depth, weights=counts) < 1.4


def test_exponentials_of_large_weights():
    z = np.array([[500, 499] + [0] * 14, [-500] * 16], np.float32)
    assert lm_score._softmax(z.copy()).sum(axis=1) == pytest.approx([1, 1])
    logs = lm_score._log_softmax(z.copy(), np.array([1, 3]))
    assert logs == pytest.approx([-1 - math.log1p(math.exp(-1)), -math.log(16)])
