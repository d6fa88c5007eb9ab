"""Held-out accuracy and the defined cases of language identification."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairsplit.llm import language
from fairsplit.llm.common import remainder, table as given
from llm_documents import table


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(given(spark, "/root/testdata/sf0.01", "documents"), remainder("doc_id", 4) != 2)


def test_held_out_accuracy(spark, model):
    docs = given(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert model.labels == ["de", "en", "es", "fr"]
    assert 0.05 < (model.weights != 0).mean() < 0.95


def test_defined_cases(spark, model):
    docs = table(spark, [(0, None), (1, ""), (2, "12 !?"), (None, "und der die das"), (4, "x" * 200_000), (4, "É")],
                 ("score", "lang_pred"))
    got = language.identify(docs, model).collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (0, 1, 2)] == [("und", 0.0)] * 3
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred in model.labels for r in got if r.doc_id in (None, 4))
    kept = language.identify(docs, model, keep=("doc_id", "text", "source"))
    assert kept.columns == ["doc_id", "text", "source", "lang_pred", "score"]
    assert language.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = table(spark, ["some text", None])
    empty = language.learn(docs, F.lit(True))
    assert [r.lang_pred for r in language.identify(docs, empty).collect()] == ["und", "und"]


def test_features_count_every_character():
    at, counts = language.features("Ab, ab")
    assert counts.sum() == 6 + 5  # pairs and triples of " ab ab "
    assert language.features("1 2")[0].size == 0
    long = "abc " * 30_000
    assert language.features(long)[1].sum() == 2 * len(long) - 1


def test_document_frequencies_cover_all_rows(spark):
    frequency, total = language.document_frequencies(table(spark, ["ab", "ab ab", None, "", "cd"]))
    at, _ = language.features("ab")
    assert total == 3 and (frequency[at] >= 2).all() and frequency.max() <= 3
