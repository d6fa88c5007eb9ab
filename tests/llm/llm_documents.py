"""Small document tables with the cases that every operator has to bear."""

from __future__ import annotations

import random

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch maple north ochre pearl".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw: random.Random, words: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(words))


def table(spark, texts, extra=()):
    """Documents numbered from 0, or pairs of id and text, with columns whose names operators use themselves."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    rows = [(i, t, None, "s", len(t or ""), *("x" for _ in extra)) for i, t in rows]
    schema = SCHEMA + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame(rows, schema)
