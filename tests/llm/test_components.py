"""Components of link tables against a plain union-find."""

from __future__ import annotations

import random

import pytest

from fairsplit.llm import components as module
from fairsplit.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("name", ["chain", "random", "odd", "none"])
def test_components(spark, name):
    draw = random.Random(3)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "random": [(draw.randrange(150), draw.randrange(150)) for _ in range(90)],
        "odd": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (-7, 3)],
        "none": [],
    }[name]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(links)
    assert len(got) == len({r.node for r in got})


def test_few_links_are_not_shuffled_for_joins(spark, monkeypatch):
    draw = random.Random(5)
    links = spark.createDataFrame([(draw.randrange(150), draw.randrange(150)) for _ in range(90)], "u long, v long")
    plan = module._small_star(module._large_star(links, True), True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few = {tuple(r) for r in components(links, "u", "v").collect()}
    monkeypatch.setattr(module, "BROADCAST_LINKS", 0)
    assert {tuple(r) for r in components(links, "u", "v").collect()} == few


def test_rounds_of_few_links_shuffle_nothing(spark, monkeypatch):
    plans, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    draw = random.Random(7)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == brute(links)
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
