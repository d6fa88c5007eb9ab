"""Benchmark decontamination over full-text indexes of training shards.

A task cuts its documents into shards and builds an FM-index of each one: the
suffix order of the shard's words, their Burrows-Wheeler transform in a wavelet
matrix, and suffix positions sampled along the text. Test phrases run through
backward search all at once; the rows they end in are located by walking to the
nearest sampled position, and the found spans are merged per document.

A word that no phrase holds can be in no occurrence, and neither can a run of
phrase words shorter than the shortest phrase. The index therefore holds the
long runs only, each closed by an end mark of its own; nothing can be missed.

No row is shuffled. The phrases are sent to the tasks in blocks of a bounded
number of words; with more blocks, the documents pass through one such step
after the other within the same job, and the spans are merged at the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_groups

WINDOW = 13
#: Words of test phrases in one block; a block is what a task holds in memory.
BLOCK_WORDS = 2_000_000
SAMPLE_STEP = 16
#: Fixed: A-Z become a-z, other ASCII that is no digit or a-z becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256))

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; a missing text has none."""
    return text.translate(WORD_BYTES).split() if text else []


class WaveletMatrix:
    """Rank and access over a sequence of small integers, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(current) - int(self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - depth)) & 1 == 1
            left, right = ones[start], ones[end]
            start = np.where(bit, zeros + left, start - left)
            end = np.where(bit, zeros + right, end - right)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 is an end mark smaller than all words and unlike the others."""
    n = len(text)
    marks = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(marks)
    rank[marks] = np.arange(len(marks))
    step = 1
    while True:
        ahead = np.full(n, 0, np.int64)
        ahead[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Backward search and location over one shard; ``text`` ends with a mark (0)."""

    def __init__(self, text: np.ndarray, largest: int, step: int = SAMPLE_STEP):
        n = len(text)
        order = suffix_order(text)
        self.size = n
        self.matrix = WaveletMatrix(text[order - 1], largest)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 1))))
        sampled = (order % step == 0) | (text[order - 1] == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length (rows of ``phrases``)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.before[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        empty = high <= low
        low[empty] = high[empty] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbol = self.matrix.access(rows[open_])
            rows[open_] = self.before[symbol] + self.matrix.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.positions[self.sample_rank[rows]] + steps


class Phrases:
    """Distinct windows of benchmark items, by length, as word numbers from 1."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            numbers = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for start in range(max(1, len(numbers) - window + 1) if numbers else 0):
                owner = owners[tuple(numbers[start:start + window])]
                if item is not None:
                    owner.add(str(item))
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.groups = [(np.array(p, np.int64), [sorted(owners[x]) for x in p])
                       for _, p in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def shard_hits(documents: list[list[bytes]], phrases: Phrases
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Occurrences in one shard: document number, first word, end word and item ids of each."""
    numbers = phrases.words
    shard = np.fromiter((n for words in documents for n in [*(numbers.get(w, 0) for w in words), 0]),
                        np.int64, sum(map(len, documents)) + len(documents))
    none = np.empty(0, np.int64)
    stops = np.flatnonzero(shard == 0)
    starts = np.concatenate(([0], stops[:-1] + 1))
    long = stops - starts >= phrases.shortest
    if not long.any() or not phrases.groups:
        return none, none, none, []
    sizes = (stops - starts + 1)[long]  # with the end mark
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(sizes.sum()) + np.repeat(starts[long] - first, sizes)
    index = FmIndex(shard[place], len(numbers))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    owners: list[list[str]] = []
    for group, items in phrases.groups:
        low, high = index.search(group)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        rows = np.arange(counts.sum()) + np.repeat(low[hit] - np.cumsum(counts) + counts, counts)
        at = place[index.locate(rows)]
        found.append((at, at + group.shape[1]))
        owners += [items[i] for i in np.repeat(hit, counts)]
    at, end = (np.concatenate(x) for x in zip(*found))
    begins = np.cumsum([0] + [len(words) + 1 for words in documents])
    document = np.searchsorted(begins, at, side="right") - 1
    return document, at - begins[document], end - begins[document], owners


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _step(phrases: Phrases, text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, text):
            documents = [words_of(x) for x in texts]
            spans = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            for document, start, end, owners in zip(*shard_hits(documents, phrases)):
                spans[document].append((int(start), int(end)))
                items[document].update(owners)
            own = {"n_words": [len(x) for x in documents],
                   "spans": [[{"start": s, "end": e} for s, e in merged(x)] for x in spans],
                   "items": [sorted(x) for x in items]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[f.name], f.type) if f.name in own else batch.column(f.name) for f in schema],
                schema=schema)
    return run


def phrase_blocks(benchmark: DataFrame, item_id: str, text: str, window: int,
                  block_words: int) -> Iterator[Phrases]:
    """Benchmark items as phrase blocks of about ``block_words`` words; streamed, never gathered whole."""
    items, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row.t.encode() if row.t else None)
        if not words:
            continue
        items.append((row.i, words))
        size += len(words)
        if size >= block_words:
            yield Phrases(items, window)
            items, size = [], 0
    if items:
        yield Phrases(items, window)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where benchmark windows occur in documents.

    Returns one row per input row: the id, ``n_words``, ``spans`` (merged runs of hit words,
    end exclusive, by word number), ``items`` (sorted ids of the items found) and the input columns of ``keep``.

    Cases: a null or word-free text has no words and no spans; repeated rows are judged one by one; a
    null id is carried along; an item without words has no window; a null item id marks words but is not
    listed; items that share an id count once; other columns of either table are ignored. Without any
    benchmark window every document is clean.
    """
    kept = docs.select(F.col(id_column), F.col(text).alias("_text"), *(F.col(c) for c in keep if c != text))
    out = kept.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPAN),
        "items": F.array().cast("array<string>")})
    blocks = 0
    for phrases in phrase_blocks(benchmark, item_id, item_text, window, block_words):
        out = _mapped(out, phrases)
        blocks += 1
    if not blocks:
        out = _mapped(out, Phrases([], window))
    return out.withColumnRenamed("_text", text) if text in keep else out.drop("_text")


def _mapped(df: DataFrame, phrases: Phrases) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return df.mapInArrow(_step(phrases, "_text", to_arrow_schema(schema)), schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and verdict per document from :func:`contaminated_spans`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return spans.withColumns({
        "n_hit": hit, "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
