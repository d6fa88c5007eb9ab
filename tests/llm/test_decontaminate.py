"""Occurrences of benchmark windows against a plain search."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from fairsplit.llm import decontaminate
from fairsplit.llm.decontaminate import FmIndex, WaveletMatrix, suffix_order, words_of
from llm_documents import prose, table


def brute(texts, items, window=13):
    owners = defaultdict(set)
    for item, text in items:
        words = words_of(text.encode() if text else None)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[start:start + window])].add(item)
    out = []
    for text in texts:
        words, hit, found = words_of(text.encode() if text else None), set(), set()
        for size in {len(o) for o in owners}:
            for start in range(len(words) - size + 1):
                key = tuple(words[start:start + size])
                if key in owners:
                    hit.update(range(start, start + size))
                    found |= owners[key] - {None}
        out.append((len(words), len(hit), sorted(map(str, found))))
    return out


def test_wavelet_matrix():
    values = np.random.default_rng(1).integers(0, 37, 300)
    matrix = WaveletMatrix(values, 36)
    assert (matrix.access(np.arange(300)) == values).all()
    for symbol in (0, 5, 36):
        ends = np.arange(301)
        expected = np.concatenate(([0], np.cumsum(values == symbol)))
        assert (matrix.rank(np.full(301, symbol), ends) == expected).all()


def test_index_finds_and_locates():
    draw = np.random.default_rng(2)
    text = np.concatenate([np.append(draw.integers(1, 4, n), 0) for n in (40, 1, 25, 60)])
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FmIndex(text, 3, step=7)
    for pattern in ([1, 2], [3, 3, 3], [2, 1, 1], [1]):
        low, high = index.search(np.array([pattern]))
        expected = [i for i in range(len(text)) if text[i:i + len(pattern)].tolist() == pattern]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_against_a_plain_search(spark, block_words):
    draw = random.Random(5)
    items = [(i, prose(draw, n)) for i, n in enumerate((20, 13, 30, 5, 1))]
    items += [(10, items[0][1]), (11, None), (12, " ?! "), (None, prose(draw, 14))]
    passage = items[0][1].split()
    texts = [prose(draw, 60), None, "", "...", prose(draw, 3),
             prose(draw, 30) + " " + items[0][1].upper() + ", " + prose(draw, 8),
             " ".join(passage[:13]), " ".join(passage[:12]), " ".join(passage[3:16] + passage[5:19]),
             items[3][1] + " " + items[4][1] + " " + items[8][1], "É" + items[1][1], prose(draw, 4000) + " " + items[1][1]]
    texts.append(texts[5])
    docs = table(spark, texts, ("spans", "items", "n_words", "n_hit"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    spans = decontaminate.contaminated_spans(docs, benchmark, block_words=block_words)
    got = {r.doc_id: r for r in decontaminate.digest(spans).collect()}
    for i, (words, hit, found) in enumerate(brute(texts, items)):
        row = got[i]
        assert (row.n_words, row.n_hit, row["items"]) == (words, hit, found)
        assert row.contaminated == (hit > 0 and 20 * hit >= words)
        assert all(a.end < b.start for a, b in zip(row.spans, row.spans[1:]))


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, [(None, "a b c"), (1, None)])
    got = decontaminate.digest(decontaminate.contaminated_spans(docs, benchmark)).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 0, 0, False), (3, 0, 0, False)]
    assert decontaminate.contaminated_spans(docs.limit(0), benchmark).count() == 0
