"""Runs against all periods tried one by one, and the digest against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fairsplit.llm import periodic_runs
from fairsplit.llm.common import table as given
from fairsplit.llm.queries import op12_periodic_runs
from llm_documents import table


def brute(words: list) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run: each period on its own, word by word."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)  # smaller periods come first
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def documents(draw: random.Random) -> list[list[str]]:
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 25, ["a", "b"] * 12, (["a", "b"] * 12)[:-1], ["a"] * 700]
    for letters in (1, 2, 3, 20):
        for size in (0, 23, 24, 40, 100, 257):
            out.append([draw.choice("abcdefghijklmnopqrstuvw"[:letters]) for _ in range(size)])
    for period in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100):
        for times in (2.5, 2.99, 3, 3.01, 4, 9.3):
            phrase = [f"w{draw.randrange(40)}" for _ in range(period)]
            run = (phrase * 10)[:int(period * times)]
            out.append([f"x{draw.randrange(9)}" for _ in range(draw.randrange(40))] + run
                       + [f"y{draw.randrange(9)}" for _ in range(draw.randrange(20))])
    inner = (["p", "q", "r"] * 10 + ["s"]) * 4  # runs within a run
    out += [inner, ["t"] + inner + ["p"], ["a"] * 30 + ["b"] * 30 + ["a"] * 30]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out += [list(fibonacci[-1]), list((fibonacci[6] * 5))]
    morse = "a"
    while len(morse) < 512:
        morse += morse.translate(str.maketrans("ab", "ba"))
    return [*out, list(morse)]


def found_in(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    every = [w for t in texts for w in t]
    number = {w: i for i, w in enumerate(dict.fromkeys(every))}
    sizes = np.array([len(t) for t in texts], np.int64)
    first, length, period = periodic_runs.find_runs(np.array([number[w] for w in every], np.int64), sizes)
    starts = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, q in zip(first.tolist(), length.tolist(), period.tolist()):
        doc = max(i for i in range(len(texts)) if starts[i] <= s and sizes[i])
        out[doc].append((s - int(starts[doc]), n, q))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_those_of_every_period(seed):
    texts = documents(random.Random(seed))
    for text, got in zip(texts, found_in(texts)):
        assert got == brute(text), text[:60]


def test_no_run_crosses_documents():
    assert found_in([["a"] * 20, ["a"] * 20, [], ["a"] * 20]) == [[], [], [], []]


def test_long_text():
    draw = random.Random(4)
    text = [f"w{draw.randrange(5000)}" for _ in range(120_000)] + ["a", "b", "c"] * 40_000
    assert found_in([text]) == [[(120_000, 120_000, 3)]]


def test_defined_cases(spark):
    run = " ".join(["one two"] * 12)
    texts = [(0, None), (1, ""), (2, run), (2, run), (None, f"x\t{run}\n\ny"), (4, "a a " * 30), (5, " \n ")]
    docs = table(spark, texts, ("runs", "collapsed", "n_words"))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
           for r in periodic_runs.periodic_runs(docs, keep=("lang",)).collect()]
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (2, 24, [(0, 24, 2)], "one two"), (2, 24, [(0, 24, 2)], "one two"),
                   (None, 26, [(1, 24, 2)], "x one two y"), (4, 30, [(0, 30, 1)], "a a"), (5, 0, [], "")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, keep=("runs",))


def test_registered_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = []
    for doc_id, text in given(spark, sf_dir, "documents").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words) if n < 1500 or h % 10 == 0 else brute_by_columns(words)
        row = (None,) * 4
        for s, length, q in runs:
            if row[0] is None or length * row[2] > row[1] * q:
                row = (s, length, q, 1000 * length // q)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((doc_id, len(runs), *row, hashlib.sha256(lines.encode()).hexdigest(),
                     hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = op12_periodic_runs(spark, sf_dir).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 50


def brute_by_columns(words: list[str]) -> list[tuple[int, int, int]]:
    """As ``brute``, with the words of one period compared by numpy."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words])
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(x) // 3 + 1):
        edges = np.diff(np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(np.int8))
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if e - s + q >= max(24, 3 * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())
