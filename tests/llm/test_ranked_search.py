"""Scores, ranks and shared sums against a plain loop."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from fairsplit.llm import ranked_search
from llm_documents import prose, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    texts = [(i, Counter(plain_terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    count, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, held in texts:
            m = 25 + (75 * sum(held.values()) * count) // length
            s = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * held[t]) // (1000 * held[t] + 8 * m))
                    for t, n in Counter(plain_terms(text)).items() if t in held)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def test_terms_of_every_sign():
    text = "".join(map(chr, range(1, 0x250))) + " Kİ Straße 12x3 naïve"
    assert [t.decode() for t in ranked_search.terms(text.encode())] == plain_terms(text)


def test_shared_sums_are_each_items_sum():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 10 ** 9, (60, 7))
    common = draw.choice(60, 15, replace=False).tolist()
    items = []
    for i in range(40):
        own = {int(t): int(draw.integers(1, 4)) for t in draw.choice(60, int(draw.integers(1, 9)), replace=False)}
        items.append(own | ({t: 1 for t in common} if i % 2 else {}))
    dag = ranked_search.share(items)
    want = np.array([sum(n * values[t] for t, n in item.items()) for item in items])
    assert (dag.evaluate(values) == want).all()
    additions = sum(len(made) for made, _, _ in dag.steps)
    assert additions < sum(len(item) - 1 for item in items) - 15 * 10


def test_items_that_hold_one_another():
    items = [{0: 1}, {0: 1}, {0: 1, 1: 1}, {0: 2}, {0: 1, 1: 1, 2: 1}, {2: 1, 1: 1, 0: 1}]
    dag = ranked_search.share(items)
    values = np.array([[1], [10], [100]])
    assert dag.evaluate(values).ravel().tolist() == [1, 1, 11, 2, 111, 111]
    assert sum(len(made) for made, _, _ in dag.steps) == 2


def test_against_a_plain_loop(spark):
    draw = random.Random(5)
    docs = [(i, prose(draw, draw.randrange(1, 60))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(30)] + [(400, None), (401, ""), (402, "?! ."), (403, "Amberbirch " * 30_000)]
    items = [(f"q{i}", prose(draw, draw.randrange(1, 15))) for i in range(25)]
    items += [("same", docs[7][1]), ("none", "zzz yyy"), ("empty", ""), ("null", None), ("twice", "amberbirch AMBERBIRCH")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, score string")
    got = ranked_search.search(table(spark, docs, ("rank", "score", "n")).repartition(5), benchmark)
    assert rows(got) == sorted(brute(docs, items))


def test_blocks_and_dags_change_nothing(spark, monkeypatch):
    draw = random.Random(6)
    docs = [(i, prose(draw, 20)) for i in range(80)]
    items = [(i, prose(draw, 6)) for i in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 30)
    monkeypatch.setattr(ranked_search, "DAG_ITEMS", 2)
    assert rows(ranked_search.search(table(spark, docs), benchmark, k=3)) == sorted(brute(docs, items, 3))


def test_defined_cases(spark):
    docs = table(spark, [(1, "alpha beta"), (1, "alpha"), (None, "alpha alpha"), (3, "gamma")])
    benchmark = spark.createDataFrame([(5, "alpha"), (5, "gamma"), (None, "alpha")], "item_id long, text string")
    got = rows(ranked_search.search(docs, benchmark))
    assert got == brute([(1, "alpha beta"), (1, "alpha"), (None, "alpha alpha"), (3, "gamma")], [(5, "alpha gamma")])
    assert rows(ranked_search.search(docs.limit(0), benchmark)) == []
    assert rows(ranked_search.search(docs, benchmark.limit(0))) == []
    assert rows(ranked_search.search(table(spark, [None, "--"]), benchmark)) == []
