"""Packing of tokenised documents into sequences of one window.

Documents are tokenised once, where they lie, and cut into full windows and a
rest. Only the histogram of rest lengths (at most one row per length) reaches
the driver. There, shallow combinations of lengths that fill a window are
enumerated, non-negative least squares gives how often each is repeated, the
counts are rounded down, and what remains is packed greedily by length class,
largest first. The plan's size depends on the window, not on the input.

A piece finds its place from its rank among the pieces of its length. Ranks
come from a number counted inside the task that cut the piece plus the sum of
the counts of earlier tasks, so no length is ever gathered in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GROUP_BYTES, stored, text_groups

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers (some 200 bytes each), and their greatest length.
CACHE_WORDS, CACHE_CHARS = 1_600_000, 64
#: Lengths, most frequent first, that combinations of three are formed from.
TRIPLE_LENGTHS = 48
NNLS_STEPS = 400

_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path() -> str:
    """Place of the default vocabulary on this machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, word by word, with a bounded memory of words.

    The vocabulary drops white space and never merges over it, so a text's ids are those of
    its parts between spaces and line feeds, in order.
    """

    MARK = "0"
    #: A full stop or comma between an ASCII letter and a gap is a part of its own.
    STOP = r"[A-Za-z][.,]\z"
    #: Where texts are prepared like this, a word of these letters is one part: lower-cased, and its bytes as characters.
    LETTERS = "\\A[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+\\z"
    _SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+\\Z")
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PARTS = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
              "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

    #: Bytes of these letters that have no visible character of their own stand as others.
    BYTES = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        #: For words of such letters: merges only.
        self.merges = None
        own = json.loads(self.tokenizer.to_str())
        if ((own["normalizer"] or {}).get("normalizers"), (own["pre_tokenizer"] or {}).get("pretokenizers")) == (
                self.NORMAL, self.PARTS):
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {"": b""}
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids

    def _learn_parts(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: joined by a mark that none of them holds, cut apart again."""
        lower = [w for w in words if self._SMALL.match(w) and len(w) <= CACHE_CHARS] if self.merges else []
        out = self._joined(self.merges, lower, True)
        out |= self._joined(self.tokenizer, [
            w for w in words if w not in out and self.MARK not in w and len(w) <= CACHE_CHARS and "<|" not in w])
        rest = [w for w in words if w not in out]
        for word, encoding in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[word] = np.array(encoding.ids, "<u4").tobytes()
        return out

    def _joined(self, tokenizer, words: list[str], as_bytes: bool = False) -> dict[str, bytes]:
        """Ids of words that do not hold the mark."""
        if not words or len(self.mark) != 1:
            return {}
        text = f" {self.MARK} ".join(words)
        if as_bytes:
            text = text.encode().decode("latin-1")
            for byte, visible in self.BYTES:
                text = text.replace(byte, visible)
        joined = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(joined.ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark[0])
        if len(cuts) != len(words) - 1:
            return {}
        raw = ids.tobytes()
        return {w: raw[4 * a:4 * b] for w, a, b in zip(words, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text: each word is looked up once, and its ids are copied to all its places."""
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        stopped = pc.match_substring_regex(words, self.STOP)
        heads = pc.if_else(stopped, pc.utf8_slice_codeunits(words, 0, -1), words)
        if self.merges:
            heads = pc.if_else(pc.match_substring_regex(heads, self.LETTERS), pc.utf8_lower(heads), heads)
        heads = heads.dictionary_encode()
        names = [*heads.dictionary.to_numpy(zero_copy_only=False).tolist(), ".", ","]
        # A difference from the dictionary itself looks the words up; one from its keys would walk over all of them.
        new = set(names).difference(self.known)
        learned = self._learn_parts(list(new)) if new else {}
        if len(self.known) + len(learned) > CACHE_WORDS:
            self.known = {"": b""}
            learned = self._learn_parts(list(set(names).difference(self.known)))
        self.known.update(learned)
        own = [self.known[w] for w in names]
        for word in learned:
            if len(word) > CACHE_CHARS:
                del self.known[word]
        ends = pa.scalar(own[-2], pa.large_binary()), pa.scalar(own[-1], pa.large_binary())
        tails = pc.if_else(stopped, pc.if_else(pc.ends_with(words, "."), *ends), pa.scalar(b"", pa.large_binary()))
        whole = pc.binary_join_element_wise(
            pa.array(own[:-2], pa.large_binary()).take(heads.indices), tails, pa.scalar(b"", pa.large_binary()))
        ids = whole.take(coded.indices)
        _, ends, data = ids.buffers()
        bounds = np.frombuffer(ends, np.int64, len(ids) + 1)[np.asarray(parts.offsets)].tolist()
        raw = memoryview(data or b"")
        return [bytes(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _pieces(path: str | None, window: int, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or tokenizer_path()
        encoder = _ENCODERS.setdefault(place, WordEncoder(place))
        part = TaskContext.get().partitionId()
        ordinals: Counter[int] = Counter()
        end = np.array([end_id], "<u4").tobytes()
        ids_of, waiting, size = [], [], 0

        def pieces() -> pa.RecordBatch:
            rows = []
            for doc_id, ids in zip(ids_of, encoder.encode([x.decode() if x else "" for x in waiting])):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    crc = zlib.crc32(ids[4 * start:4 * (start + length)])
                    rows.append((doc_id, start, length, crc, total, part, ordinals[length]))
                    ordinals[length] += 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch, texts in text_groups(batches, "text"):
            ids_of += batch.column("doc_id").to_pylist()
            waiting += texts
            size += sum(len(x or b"") for x in texts)
            if size >= GROUP_BYTES:
                yield pieces()
                ids_of, waiting, size = [], [], 0
        if waiting:
            yield pieces()
    return run


def combinations(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Fillings of the window by one, two or three of the given lengths.

    Pairs are exact or, where no exact partner exists, the nearest that fits; triples start from
    the most frequent lengths.
    """
    lengths = np.array(sorted(counts))
    out: set[tuple[int, ...]] = set()
    for a in lengths:
        at = int(np.searchsorted(lengths, window - a, side="right")) - 1
        if at >= 0:
            out.add(tuple(sorted((int(a), int(lengths[at])), reverse=True)))
    frequent = sorted(counts, key=lambda n: (-counts[n], n))[:TRIPLE_LENGTHS]
    for i, a in enumerate(frequent):
        for b in frequent[i:]:
            at = int(np.searchsorted(lengths, window - a - b, side="right")) - 1
            if at >= 0:
                out.add(tuple(sorted((a, b, int(lengths[at])), reverse=True)))
    return sorted(out, key=lambda c: (-sum(c), len(c), c))


def repeat_counts(patterns: list[tuple[int, ...]], counts: dict[int, int], steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats whose pieces come closest to the histogram.

    Accelerated projected gradient steps; a column holds how often its combination uses each length.
    """
    lengths = sorted(counts)
    row_of = {n: i for i, n in enumerate(lengths)}
    cells = [(row_of[n], j, m) for j, p in enumerate(patterns) for n, m in Counter(p).items()]
    row, column, weight = (np.array(x) for x in zip(*cells))
    wanted = np.array([counts[n] for n in lengths], float)

    def times(x):
        return np.bincount(row, weight * x[column], len(lengths))

    def back(y):
        return np.bincount(column, weight * y[row], len(patterns))

    bound = float((back(np.ones(len(lengths)))).max() * times(np.ones(len(patterns))).max())
    x = ahead = np.zeros(len(patterns))
    speed = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - back(times(ahead) - wanted) / bound)
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead, x, speed = new + (speed - 1) / faster * (new - x), new, faster
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths with their repeats; together they use every counted piece once."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> None:
        need = Counter(pattern)
        repeats = min([most, *(left.get(n, 0) // m for n, m in need.items())])
        if repeats > 0:
            out.append((pattern, repeats))
            for n, m in need.items():
                left[n] -= m * repeats
                if not left[n]:
                    del left[n]

    full = left.pop(window, 0)
    if full:
        out.append(((window,), full))
    if left:
        patterns = combinations(left, window)
        for pattern, x in zip(patterns, np.floor(repeat_counts(patterns, left) + 1e-9).astype(np.int64)):
            take(pattern, int(x))
    while left:
        room, pattern, used = window, [], Counter()
        for n in sorted(left, reverse=True):
            m = min(left[n], room // n)
            if m:
                # A length repeats within one sequence only if no shorter one is left to mix it with.
                pattern += [n] * m
                used[n] = m
                room -= n * m
            if not room:
                break
        take(tuple(pattern), min(left[n] // m for n, m in used.items()))
    return out


class Places:
    """Sequence and offset of the r-th piece of a length, under a plan."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        first = 0
        per: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        taken: Counter[int] = Counter()
        for pattern, repeats in patterns:
            offsets: dict[int, list[int]] = {}
            at = 0
            for n in pattern:
                offsets.setdefault(n, []).append(at)
                at += n
            for n, slots in offsets.items():
                per.setdefault(n, []).append((taken[n], first, len(slots), slots))
                taken[n] += len(slots) * repeats
            first += repeats
        self.sequences = first
        self.per = {n: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v]),
                        np.cumsum([0] + [x[2] for x in v]), np.concatenate([np.array(x[3]) for x in v]))
                    for n, v in per.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            starts, firsts, many, slot_starts, slots = self.per[int(n)]
            segment = np.searchsorted(starts, ranks[at], side="right") - 1
            turn, slot = np.divmod(ranks[at] - starts[segment], many[segment])
            sequence[at] = firsts[segment] + turn
            offset[at] = slots[slot_starts[segment] + slot]
        return sequence, offset


def _placed(places: Places, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = places.find(lengths, ranks)
            own = {"sequence_id": sequence, "offset": offset}
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[f.name], f.type) if f.name in own else batch.column(f.name) for f in schema],
                schema=schema)
    return run


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every id of every document in exactly one piece, every piece in one sequence.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``path`` names
    the vocabulary file on every machine; without it, the installed public one is used.

    Cases: a null or empty text is its end id alone; repeated rows are packed each; a null id is carried
    along; other columns are ignored; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    shape = StructType([source.schema["doc_id"], *(StructField(c, LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "part", "ordinal"))])
    pieces = stored(source.mapInArrow(_pieces(path, window, end_id, to_arrow_schema(shape)), shape), "pieces")
    counted = stored(pieces.groupBy("part", "length").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(plan(histogram, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = (pieces.join(before, ["part", "length"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("ordinal") + F.col("before")).alias("rank"),
                      F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    shape = StructType([StructField(f.name, f.dataType) for f in ranked.schema])
    return ranked.mapInArrow(_placed(places, to_arrow_schema(shape)), shape).drop("rank")
