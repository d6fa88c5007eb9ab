"""Removed bytes against a plain scan over all passages."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from fairsplit.llm import suffix_dedup
from llm_documents import prose, table


def brute(rows, size=50):
    seen: dict[bytes, int] = {}
    for i, text in sorted((i, t) for i, t in rows if i is not None):
        data = (text or "").encode()
        for k in range(len(data) - size + 1):
            seen.setdefault(data[k:k + size], i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - size + 1 if i is not None else 0):
            if seen[data[k:k + size]] < i:
                gone[k + 1:k + size + 1] = True
        kept = bytes(b for b, g in zip(data, gone[1:-1]) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk,slab", [(2_000_000, 1_000_000), (600, 300)])
def test_against_a_plain_scan(spark, monkeypatch, chunk, slab):
    monkeypatch.setattr(suffix_dedup, "SLAB", slab)
    draw = random.Random(chunk)
    base = [prose(draw, 40) for _ in range(5)]
    texts = [base[0], None, "", base[0][:49], base[0][:50], base[0][7:57] + "!" + base[0][7:56], base[0],
             base[1][:90] + base[2][:200] + base[1][80:], base[2], base[1], base[3] + base[3], base[3][10:300],
             "ab" * 200, "x" + "ab" * 100, "\0" * 80, "\0" * 60, "é" * 60, "xé" * 10 + "é" * 45, prose(draw, 700),
             base[4][:120], base[4][60:200], base[4]]
    rows = list(enumerate(texts)) + [(2, base[0]), (30, base[4]), (30, base[4]), (None, base[0]), (None, base[0])]
    docs = table(spark, rows[::-1], ("chunk", "tokens", "kept", "spans")).repartition(4)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_segments_cover_every_passage(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 64)
    draw = np.random.default_rng(1)
    sizes = [130, 0, 49, 50, 51, 300]
    data, ends = draw.integers(97, 100, sum(sizes)).astype(np.uint8), np.cumsum(sizes)
    starts, counts, tokens = suffix_dedup.segments(data, ends)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, counts)])
    begins = np.concatenate(([0], ends[:-1]))
    expected = [k for a, b in zip(begins, ends) for k in range(a, b - 49)]
    assert covered.tolist() == expected and counts.max() <= suffix_dedup.SPREAD
    by_passage = {}
    for s, n, t in zip(starts, counts, tokens):
        for k in range(s, s + n):
            assert by_passage.setdefault(data[k:k + 50].tobytes(), t) == t


def test_multikey_sort():
    draw = np.random.default_rng(2)
    columns = [draw.integers(0, 3, 500) for _ in range(4)]
    order, number = suffix_dedup.multikey_sort(columns)
    rows = [tuple(c[i] for c in columns) for i in order]
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(rows, rows[1:])] == (np.diff(number) == 0).tolist()


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(table(spark, ["a"]).limit(0)).count() == 0
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, [None, "a"]))).count() == 2
