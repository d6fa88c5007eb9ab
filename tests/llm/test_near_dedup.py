"""Components of near duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fairsplit.llm import near_dedup
from llm_documents import prose, table


def brute(rows, width=2):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        runs = [tuple(words[k:k + width]) for k in range(len(words) - width + 1)]
        sets[i] = frozenset(runs) if runs else frozenset([tuple(words)] if words else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(draw, text, changes):
    words = text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = prose(draw, 1)
    return " ".join(words)


def test_against_all_pairs(spark):
    draw = random.Random(11)
    texts = [None, "", "one", "ONE", "one two", " one\ttwo\n", "two one", "é É", "É É", prose(draw, 3000)]
    for _ in range(25):
        base = prose(draw, 120)
        texts += [base] + [edited(draw, base, draw.randrange(1, 9)) for _ in range(draw.randrange(4))]
    hub = prose(draw, 150)
    texts += [edited(draw, hub, 5) for _ in range(60)] + [hub] * 5 + [edited(draw, texts[9], 4)]
    rows = list(enumerate(texts))
    docs = table(spark, rows[::-1], ("component_id", "labels", "print")).repartition(5)
    got = near_dedup.near_duplicates(docs).collect()
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_threshold_is_inclusive(spark):
    """Four shared shingles of five are exactly four fifths; of six, or three of four, are fewer."""
    for left, right in (("a b c d e", "a b c d e f"), ("a b c d e f", "a b c d e x"), ("a b c d", "a b c d e")):
        got = near_dedup.near_duplicates(table(spark, [left, right])).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([(0, left), (1, right)])


def test_repeated_rows_and_missing_ids(spark):
    docs = table(spark, [(7, "a b c"), (7, "a b c"), (None, "a b c"), (9, "a b c"), (3, "z")])
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, None, True), (3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [40, 700])
def test_neighbourhoods_are_not_cut(spark, rows):
    """Pairs are found wherever the range partitions end."""
    draw = random.Random(rows)
    texts = []
    for _ in range(rows // 2):
        base = prose(draw, 40)
        texts += [base, base + " " + prose(draw, 1)]
    got = near_dedup.near_duplicates(table(spark, texts)).collect()
    assert sum(r.kept for r in got) == rows // 2


def test_pairs_inside_a_large_family(spark):
    """A template makes 0.785 of every pair; a few pairs, far from each other, share some more and are at 0.82."""
    draw = random.Random(5)
    template = prose(draw, 264)
    own = [prose(draw, 36).split() for _ in range(300)]
    for i in range(0, 60, 2):
        own[299 - i][:7] = own[i][:7]
    rows = [(i, f"{template} {' '.join(words)}") for i, words in enumerate(own)]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert sum(not r.kept for r in got) >= 30


def test_width_of_shingles(spark):
    """Two edits in 75 words: alike in word pairs, apart in runs of five words; a shorter text is one shingle."""
    base = prose(random.Random(9), 75).split()
    texts = [" ".join(base), " ".join("new" if i in (20, 50) else w for i, w in enumerate(base)), "a b c", "A b  c", "a b"]
    for words, expected in ((2, [0, 0, 2, 2, 4]), (5, [0, 1, 2, 2, 4])):
        got = near_dedup.near_duplicates(table(spark, texts), words=words).collect()
        assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == expected
        assert [r.n_shingles for r in sorted(got, key=lambda r: r.doc_id)][2:4] == ([2, 2] if words == 2 else [1, 1])


def test_few_open_pairs_are_tested_in_one_pass(spark, monkeypatch):
    """One pass over all of them, or the best of each two components first: the same components."""
    sets = [list(range(20)), list(range(19)), [*range(20), 50], [*range(40, 60)], [*range(40, 59)], [*range(18), 90]]
    docs = spark.createDataFrame([(i, np.array(s, np.uint64).tobytes()) for i, s in enumerate(sets)], "doc_id long, shingles binary")
    pairs = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(i + 1, 6)], "a long, b long, score float")
    tied = spark.createDataFrame([(4, 3)], "node long, component long")
    tested = spark.createDataFrame([(3, 4, True)], "a long, b long, linked boolean")
    names, real = [], near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: names.append(name) or real(df, name))
    passes = []
    for most in (20_000, 0):
        monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", most)
        found = near_dedup._closed(pairs, tied, tested, docs, 80)[0].collect()
        assert {r.node: r.component for r in found} == {1: 0, 2: 0, 5: 0, 4: 3}
        passes.append(names.count("checked"))
        names.clear()
    assert passes == [1, 2]
