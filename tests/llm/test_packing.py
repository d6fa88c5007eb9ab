"""Packing: exact round trip, gapless sequences, little padding."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fairsplit.llm import packing
from llm_documents import prose, table

ODD = ["Don't stop. 3.14, a.b, x. ", "tab\there\u00a0nbsp\u3000wide", "<|endoftext|> in. text", "caf\u00e9 cafe\u0301. \u1e9e\u0130 \u03a3\u03a3.",
       "0 00 0.0 a0 0", "\u4e2d\u6587" * 40, "!!. !!, ...", "\U0001f600.", "it's, we'll. I'VE.", "a" * 300 + ".", "\r\n x\x0by\x85z"]


def reference(text):
    ids = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def test_word_by_word_ids_are_the_tokenizers():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    draw = random.Random(1)
    texts = [*ODD, "", " ", "\n", prose(draw, 200).title() + ". " + prose(draw, 5), ". ".join(ODD)]
    for again in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [reference(t).tolist() for t in texts]


def test_the_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    draw = random.Random(2)
    for _ in range(4):
        text = prose(draw, 30)
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == reference(text).tolist()


def test_every_id_is_in_one_piece(spark):
    draw = random.Random(3)
    texts = [None, "", *ODD, *(prose(draw, draw.randrange(1, 900)) for _ in range(60)), prose(draw, 4000)]
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3])]
    got = packing.pack(table(spark, rows, ("length", "start", "part")).repartition(5)).collect()
    ids = {i: np.append(reference(t or ""), np.uint32(1)).astype("<u4") for i, t in rows}
    pieces = defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    copies = Counter(i for i, _ in rows)
    for i, own in ids.items():
        expected = [k for k in range(len(own)) for _ in range(copies[i])]
        assert sorted(k for s, n in pieces[i] for k in range(s, s + n)) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(len(ids[i]) for i, _ in rows)
    assert total / (len(sequences) * packing.WINDOW) > 0.9
    assert packing.pack(table(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    counts = {int(n): int(c) for n, c in zip(draw.choice(np.arange(1, 129), 60, replace=False), draw.integers(1, 400, 60))}
    plan = packing.plan(counts, 128)
    used = Counter()
    for pattern, repeats in plan:
        assert sum(pattern) <= 128 and repeats > 0
        for n, m in Counter(pattern).items():
            used[n] += m * repeats
    assert used == Counter(counts)
    full = sum(n * c for n, c in counts.items()) / (128 * sum(r for _, r in plan))
    assert full > 0.9  # greedy packing alone reaches 0.92 to 0.97 here
    places = packing.Places(plan)
    seen = set()
    for n, c in counts.items():
        sequence, offset = places.find(np.full(c, n), np.arange(c))
        seen |= {(int(s), int(o) + k) for s, o in zip(sequence, offset) for k in range(n)}
    assert len(seen) == sum(n * c for n, c in counts.items())


def test_least_squares_meets_the_histogram():
    counts = {100: 50, 28: 50, 64: 30}
    patterns = packing.combinations(counts, 128)
    x = packing.repeat_counts(patterns, counts, 4000)
    got = Counter()
    for pattern, times in zip(patterns, x):
        for n in pattern:
            got[n] += times
    assert all(abs(got[n] - c) < 1 for n, c in counts.items())


def test_words_of_letters_need_merges_only():
    """Lower-cased and written as bytes, they have the tokenizer's ids, and words of other case are not merged again."""
    encoder = packing.WordEncoder(packing.tokenizer_path())
    letters = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha() and c not in (0xAA, 0xB5, 0xBA)]
    draw = random.Random(7)
    words = [*letters, *("".join(draw.choices(letters, k=draw.randrange(2, 15))) for _ in range(3000))]
    merged = []
    joined = encoder._joined
    encoder._joined = lambda tokenizer, new, *more: merged.append((tokenizer, len(new))) or joined(tokenizer, new, *more)
    text = " ".join(words)
    for x in (text, text.lower(), text):
        assert np.frombuffer(encoder.encode([x])[0], "<u4").tolist() == reference(x).tolist()
    assert sum(n for t, n in merged if t is encoder.merges) == len({w.lower() for w in words})
    assert sum(n for t, n in merged if t is encoder.tokenizer) == len(".,")
