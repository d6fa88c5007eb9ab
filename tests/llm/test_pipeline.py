"""The corpus pipeline against the plain versions of its stages."""

from __future__ import annotations

import random

import corpus_pipeline
from llm_documents import prose
from test_decontaminate import brute as plain_spans
from test_line_dedup import brute as plain_lines
from test_near_dedup import brute as plain_groups
from test_near_dedup import edited
from test_packing import reference

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(draw, items):
    base = ["\n".join(prose(draw, 25) for _ in range(3)) for _ in range(12)]
    texts = [*base, None, "", "123 !!", base[0], base[1] + "\n" + prose(draw, 30), edited(draw, base[2].replace("\n", " "), 2),
             prose(draw, 10) + " " + items[0], prose(draw, 600) + " " + items[1][:200], items[2], base[3].upper(),
             "\n".join([base[4].split("\n")[0], prose(draw, 40)])]
    return [(i, t, draw.choice(["en", "xx", None]), "s", len(t or "")) for i, t in enumerate(texts)]


def test_against_plain_stages(spark, tmp_path):
    draw = random.Random(8)
    items = [prose(draw, 24) for _ in range(3)]
    rows = corpus(draw, items)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    cleaned = plain_lines(left)
    left = [(i, cleaned[i]) for i, _ in left if cleaned[i].strip()]
    groups = plain_groups(left, width=5)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    spans = plain_spans([t for _, t in left], list(enumerate(items)))
    left = [(i, t) for (i, t), (words, hit, _) in zip(left, spans) if not (hit and 20 * hit >= words)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in got}
    assert tokens == {i: len(reference(t)) + 1 for i, t in left}
    for i, n in tokens.items():
        assert sum(r.length for r in got if r.doc_id == i) == n


def test_stages_keep_the_columns(spark, tmp_path):
    """Also for an empty table."""
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.dtypes) == sorted(docs.dtypes)
        assert out.count() == 0
