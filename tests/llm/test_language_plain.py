"""Features, training and temperature of language identification against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from fairsplit.llm import language
from llm_documents import table

WORDS = {"de": "der und nicht über straße wald", "en": "the and not over street wood", "es": "el y no sobre calle bosque"}


def corpus(seed: int = 5) -> list[tuple[str, str]]:
    draw = random.Random(seed)
    return [(lang, " ".join(draw.choice(words.split()) for _ in range(draw.randint(1, 9))))
            for lang, words in WORDS.items() for _ in range(7)]


def plain_features(text: str) -> dict[int, int]:
    """Buckets of the pairs and triples, one after the other in whole numbers modulo 2^32."""
    if not any(c.isalpha() for c in text):
        return {}
    cut = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    points, whole = [ord(c) for c in cut], 1 << 32

    def bucket(h: int) -> int:
        return (h ^ (h >> 15)) * 0x2C1B3C6D % whole >> 17

    pair = [(a * 0x9E3779B1 + b * 0x85EBCA77) % whole for a, b in zip(points, points[1:])]
    triple = [(h * 0xC2B2AE3D + c * 0x27D4EB2F + 1) % whole for h, c in zip(pair, points[2:])]
    return Counter(bucket(h) for h in pair + triple)


def plain_idf(texts: list[str]) -> dict[int, float]:
    known = [set(plain_features(t)) for t in texts if plain_features(t)]
    return {b: math.log((1 + len(known)) / (1 + sum(b in k for k in known))) + 1 for b in set().union(*known)}


def plain_vector(text: str, idf: dict[int, float]) -> dict[int, float]:
    x = {b: (1 + math.log(n)) * idf[b] for b, n in plain_features(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {b: v / norm for b, v in x.items()}


def plain_softmax(z: list[float]) -> list[float]:
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def rows_of(texts: list[tuple[str, str]], held=lambda i: False):
    return [(lang, *language.features(t), held(i)) for i, (lang, t) in enumerate(texts)]


def dense(idf: dict[int, float]) -> np.ndarray:
    out = np.zeros(language.BUCKETS)
    for b, v in idf.items():
        out[b] = v
    return out


def test_features_count_pairs_and_triples():
    for text in ["", "12 !?", "a", "Über  die--Straße 7", "x" * 9000, "ab 𐐀𐐁 cd", *(t for _, t in corpus())]:
        at, counts = language.features(text)
        assert dict(zip(at.tolist(), counts.tolist())) == dict(plain_features(text))


def test_document_frequencies_cover_all_rows(spark):
    texts = [None, "", "12", *(t for _, t in corpus()), "the and", "the and"]
    seen, total = language.document_frequencies(table(spark, texts))
    sets = [set(plain_features(t or "")) for t in texts]
    want = Counter(b for s in sets for b in s)
    assert total == sum(map(bool, sets))
    assert {int(b): int(seen[b]) for b in np.flatnonzero(seen)} == dict(want)


def test_training_takes_the_steps_of_a_plain_loop():
    texts = corpus()
    idf = plain_idf([t for _, t in texts])
    passes, rate, smooth, l1, l2, seed = 2, 0.3, 1.0, 0.2, 0.5, 3  # a penalty that leaves zeros
    model = language.train(rows_of(texts), dense(idf), passes, rate, smooth, l1, l2, seed)
    labels = sorted(WORDS)
    z, n, constant = Counter(), Counter(), language.BUCKETS

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((smooth + math.sqrt(n[k])) / rate + l2)

    draw = np.random.default_rng(seed)
    for _ in range(passes):
        for i in draw.permutation(len(texts)):
            lang, text = texts[i]
            x = plain_vector(text, idf) | {constant: 1.0}
            now = {(b, y): weight((b, y)) for b in x for y in labels}
            p = plain_softmax([sum(v * now[b, y] for b, v in x.items()) for y in labels])
            for b, v in x.items():
                for y, py in zip(labels, p):
                    g, k = v * (py - (y == lang)), (b, y)
                    z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / rate * now[k]
                    n[k] += g * g
    assert model.labels == labels
    for j, y in enumerate(labels):
        assert math.isclose(model.bias[j], weight((constant, y)), abs_tol=1e-9)
        for b in idf:
            assert math.isclose(model.weights[b, j], weight((b, y)), abs_tol=1e-9)
    assert 0 < np.count_nonzero(model.weights) < 3 * len(idf)


def test_temperature_is_the_best_of_a_fine_grid():
    texts = corpus()
    texts += [(lang, t) for (_, t), lang in zip(corpus(9), ["en", "de", "es"] * 7)]  # some with a wrong label
    model = language.train(rows_of(texts, lambda i: i % 2 == 0), dense(plain_idf([t for _, t in texts])))
    held = [x for i, x in enumerate(texts) if i % 2 == 0]

    def loss(t: float) -> float:
        total = 0.0
        for lang, text in held:
            z = model.logits(*language.features(text)) / t
            total -= math.log(plain_softmax(z.tolist())[model.labels.index(lang)] + 1e-300)
        return total / len(held)

    best = min(loss(t) for t in np.geomspace(0.05, 20, 2001))
    assert loss(model.temperature) <= best + 1e-3 and 0.05 <= model.temperature <= 20


def test_scores_are_calibrated_probabilities():
    texts = corpus()
    idf = plain_idf([t for _, t in texts])
    model = language.train(rows_of(texts), dense(idf))
    for lang, text in texts:
        x = plain_vector(text, idf)
        z = [sum(v * model.weights[b, j] for b, v in x.items()) + model.bias[j] for j in range(len(model.labels))]
        p = plain_softmax([v / model.temperature for v in z])
        got, score = model.predict(text)
        assert math.isclose(score, max(p), abs_tol=1e-9) and model.labels[p.index(max(p))] == got
