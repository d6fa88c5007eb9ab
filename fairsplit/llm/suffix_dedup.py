"""Removal of byte passages that repeat from an earlier document, by partitioned suffix sorting.

A passage of ``LENGTH`` bytes is a suffix cut to that length. Its leading token is
the least hash among its runs of ``GRAM`` bytes; equal passages have the same one,
and neighbouring passages mostly share it, so a document's passages fall into
segments of up to 27 that travel as one record of at most 76 bytes.

1. Documents are packed into chunks, written once. A count over leading tokens
   finds those that occur in two documents or more; all others are done.
2. The segments of the rest are dealt to buckets by leading token, between
   splitters that are sampled from those tokens; a bucket boundary never parts
   equal tokens, so no comparison crosses it. Equal segments of a chunk are sent
   once, with the smallest document they occur in.
3. A bucket sorts its segments by multikey quicksort: by one word of eight bytes
   after the other, and only within ties. Where a token has several segments, their
   passages are sorted in the same way. Equal neighbours get the smallest document.
4. A chunk learns, for each passage it sent, whether an earlier document has it,
   and cuts the covered bytes out.

Tokens, segments and passages are compared by their bytes where it matters: a
hash decides only what is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored, text_groups

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1
WIDTH = 80
#: Bytes of one chunk (one document at least), and passages that are hashed at once.
CHUNK_BYTES, SLAB = 2_000_000, 500_000
#: Leading tokens that the splitters are taken from, and passages sorted at once.
SPLITTER_SAMPLE, SORT_ROWS = 20_000, 200_000
_RANDOM = np.random.default_rng(50)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)
PACK_LEVEL = 6


def _packed_bytes(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=PACK_LEVEL).compress(data, asbytes=True) if data else b""


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by joining runs of 1, 2, 4, 8 and 16."""
    with np.errstate(over="ignore"):
        h = {1: _BYTE[data]}
        for n in (1, 2, 4, 8):
            factor = np.uint64(pow(_BASE, n, 1 << 64))
            h[2 * n] = h[n][:-n] * factor + h[n][n:]
            if n < 4:
                del h[n]
        both = h[16][:-8] * np.uint64(pow(_BASE, 8, 1 << 64)) + h[8][16:]
    return mix(both)


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First passage, number of passages and leading token of each segment of a chunk's documents.

    ``ends`` are the ends of the documents in ``data``; a passage lies within one document.
    """
    starts, counts, tokens = [], [], []
    for low in range(0, max(0, len(data) - LENGTH + 1), SLAB):
        high = min(len(data) - LENGTH + 1, low + SLAB)
        hashes = _gram_hashes(data[low:high + LENGTH - 1])
        key = (hashes & ~_PLACE) | (np.arange(len(hashes), dtype=np.uint64) & _PLACE)
        least = key
        for n in (1, 2, 4, 8):
            least = np.minimum(least[:-n], least[n:])
        least = np.minimum(least[:high - low], least[SPREAD - 16:SPREAD - 16 + high - low])
        passage = np.arange(high - low, dtype=np.uint64)
        at = (passage + (((least & _PLACE) - passage) & _PLACE)).astype(np.int64)
        inside = np.ones(high - low, bool)
        first = int(np.searchsorted(ends, low, side="right"))
        last = int(np.searchsorted(ends, high + LENGTH, side="right"))
        for end in ends[first:last].tolist():
            inside[max(0, end - LENGTH + 1 - low):max(0, end - low)] = False
        own = np.flatnonzero(inside)
        if not len(own):
            continue
        new = np.concatenate(([True], (np.diff(own) != 1) | (np.diff(at[own]) != 0)))
        begin = np.flatnonzero(new)
        starts.append(own[begin] + low)
        counts.append(np.diff(np.append(begin, len(own))))
        tokens.append(hashes[at[own[begin]]])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(tokens)


class Chunk:
    """Documents of one packed row."""

    def __init__(self, row: dict):
        size = row["size"]
        self.data = np.frombuffer(pa.decompress(row["texts"], size, codec="zstd"), np.uint8) if size else \
            np.empty(0, np.uint8)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.present = np.frombuffer(row["present"], bool)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.starts, self.counts, self.tokens = segments(self.data, self.ends)
        self.owner = np.searchsorted(self.ends, self.starts, side="right")
        known = self.present[self.owner]
        self.starts, self.counts, self.tokens, self.owner = (
            x[known] for x in (self.starts, self.counts, self.tokens, self.owner))

    def repeated(self, tokens: np.ndarray) -> Sent:
        """The segments with one of these (sorted) leading tokens."""
        at = np.minimum(np.searchsorted(tokens, self.tokens), max(0, len(tokens) - 1))
        keep = np.flatnonzero(tokens[at] == self.tokens) if len(tokens) else np.empty(0, np.int64)
        return Sent(self, keep)


class Sent:
    """Distinct segments that a chunk sends: tokens, bytes and the smallest document of each."""

    def __init__(self, chunk: Chunk, keep: np.ndarray):
        self.starts, self.counts, self.owner = chunk.starts[keep], chunk.counts[keep], chunk.owner[keep]
        self.document = chunk.ids[self.owner]
        rows = np.zeros((len(keep), WIDTH + 8), np.uint8)
        rows[:, :8] = chunk.tokens[keep].astype(">u8").view(np.uint8).reshape(-1, 8)
        padded = np.concatenate((chunk.data, np.zeros(WIDTH, np.uint8)))
        reach = np.arange(LENGTH + SPREAD - 1)
        for start in range(0, len(keep), 50_000):
            part = slice(start, start + 50_000)
            cut = padded[self.starts[part, None] + reach]
            cut[reach >= (self.counts[part] + LENGTH - 1)[:, None]] = 0
            rows[part, 8:8 + len(reach)] = cut
        rows[:, -1] = self.counts
        words = rows.view(">u8").astype(np.uint64)
        order, number = multikey_sort([words[:, i] for i in range(words.shape[1])])
        self.number = np.empty(len(keep), np.int64)
        self.number[order] = number
        first = np.flatnonzero(np.diff(number, prepend=-1))
        self.rows = rows[order[first]]
        self.least = np.minimum.reduceat(self.document[order], first) if len(first) else np.empty(0, np.int64)
        self.tokens = words[order[first], 0]


def multikey_sort(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several columns, each one sorted only within the ties of those before, and the number
    of each ordered row's class of equal rows."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(columns[0], kind="stable")
    value = columns[0][order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    for column in columns[1:]:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(at):
            break
        rows, group = order[at], np.cumsum(new)[at]
        value = column[rows]
        sub = np.lexsort((value, group))
        order[at] = rows[sub]
        value, group = value[sub], group[sub]
        new[at[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    return order, np.cumsum(new) - 1


PACKED = "chunk long, size long, ids binary, present binary, ends binary, texts binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list[int | None] = []
    texts: list[bytes] = []

    def row() -> pa.RecordBatch:
        data = b"".join(texts)
        out = (number, len(data), np.array([i or 0 for i in ids], np.int64).tobytes(),
               np.array([i is not None for i in ids]).tobytes(),
               np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(),
               _packed_bytes(data))
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(out)],
            names=[f.split()[0] for f in PACKED.split(", ")])

    size = 0
    for batch, some in text_groups(batches, "text", CHUNK_BYTES):
        for doc, text in zip(batch.column("doc_id").to_pylist(), some):
            ids.append(doc)
            texts.append(text or b"")
            size += len(texts[-1]) + 64
            if size >= CHUNK_BYTES:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield row()


def _token_rows(buckets: int):
    """Distinct leading tokens of each chunk by bucket, and which of them two of its documents have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk(r)
                order = np.argsort(chunk.tokens, kind="stable")
                tokens, owner = chunk.tokens[order], chunk.owner[order]
                first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else order
                several = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) if len(first) \
                    else np.empty(0, bool)
                tokens = tokens[first]
                bucket = (tokens >> np.uint64(48)) % np.uint64(buckets)
                out = []
                for b in np.unique(bucket).tolist():
                    at = bucket == b
                    low = tokens[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    high = (tokens[at] >> np.uint64(48)).astype("<u2")
                    out.append((b, r["chunk"], low.tobytes(), high.tobytes(), np.packbits(several[at]).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                        names=["bucket", "chunk", "low", "high", "several"])
    return run


def _count_tokens(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, its tokens that another document has as well."""
    rows, parts = table.to_pylist(), []
    for r in rows:
        high = np.frombuffer(r["high"], "<u2").astype(np.uint64)
        low = np.zeros((len(high), 8), np.uint8)
        low[:, :6] = np.frombuffer(r["low"], np.uint8).reshape(-1, 6)
        several = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(high)).astype(bool)
        parts.append(((high << np.uint64(48)) | low.view("<u8").ravel(), several))
    tokens, several = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(tokens, kind="stable")
    ordered = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(first, len(ordered)))
    hot = np.empty(len(tokens), bool)
    hot[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(several[order], first), sizes)
    out, start = [], 0
    for r, (own, _) in zip(rows, parts):
        got = own[hot[start:start + len(own)]]
        start += len(own)
        if len(got):
            out.append((r["chunk"], got.astype("<u8").tobytes()))
    chunk, got = zip(*out) if out else ((), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "tokens": pa.array(got, pa.binary())})


def _joined(parts: list[bytes]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(parts), "<u8").astype(np.uint64))


#: Of a token, 32 bits go along: equal ones still meet, and others that meet by chance differ in their bytes.
SENT = "bucket int, chunk long, count int, tokens binary, rows binary, least binary"


def _send(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sent = Chunk(r).repeated(_joined(r["tokens"]))
                bucket = np.searchsorted(splitters, sent.tokens, side="right")
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = []
                for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                    out.append((int(bucket[start]), r["chunk"], end - start,
                                sent.tokens[start:end].astype("<u4").tobytes(),
                                _packed_bytes(sent.rows[start:end, 8:].tobytes()), sent.least[start:end].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(),
                                                                    *[pa.binary()] * 3))],
                        names=["bucket", "chunk", "count", "tokens", "rows", "least"])
    return run


def earlier(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each segment record, which of its passages occur in a document before ``least``, as bits."""
    words = rows.view(">u8").astype(np.uint64)
    order, number = multikey_sort([words[:, i] for i in range(words.shape[1])])
    first = np.flatnonzero(np.diff(number, prepend=-1))
    smallest = np.minimum.reduceat(least[order], first)  # of each distinct segment
    distinct = order[first]
    token = words[distinct, 0]
    count = rows[distinct, -1].astype(np.int64)
    alone = np.ones(len(distinct), bool)
    alone[1:] &= token[1:] != token[:-1]
    alone[:-1] &= token[1:] != token[:-1]
    found = np.repeat(smallest[:, None], SPREAD, axis=1)  # of each passage
    several = np.flatnonzero(~alone)
    group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1])))[several] if len(several) else several
    start = 0
    while start < len(several):
        # Whole tokens at a time, about SORT_ROWS passages.
        stop = start + int(np.searchsorted(np.cumsum(count[several[start:]]), SORT_ROWS)) + 1
        stop = int(np.searchsorted(group, group[min(stop, len(several)) - 1], side="right"))
        part = several[start:stop]
        which = np.repeat(part, count[part])
        place = np.arange(len(which)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        passages = np.zeros((len(which), 56), np.uint8)
        reach = np.arange(LENGTH)
        for low in range(0, len(which), 100_000):
            cut = slice(low, low + 100_000)
            passages[cut, :LENGTH] = rows[distinct[which[cut]][:, None], 8 + place[cut, None] + reach]
        keys = passages.view(">u8").astype(np.uint64)
        by, kind = multikey_sort([token[which], *(keys[:, i] for i in range(keys.shape[1]))])
        begin = np.flatnonzero(np.diff(kind, prepend=-1))
        found[which[by], place[by]] = np.minimum.reduceat(smallest[which[by]], begin)[kind]
        start = stop
    bits = np.zeros(len(rows), np.uint32)
    held = np.empty(len(rows), np.int64)
    held[order] = number
    for i in range(SPREAD):
        bits |= ((found[held, i] < least) & (i < rows[:, -1])).astype(np.uint32) << np.uint32(i)
    return bits


def _sort_bucket(table: pa.Table) -> pa.Table:
    parts = table.to_pylist()
    rows = np.zeros((sum(r["count"] for r in parts), WIDTH + 8), np.uint8)
    start = 0
    for r in parts:
        part = slice(start, start + r["count"])
        rows[part, 4:8] = np.frombuffer(r["tokens"], "<u4").astype(">u4").view(np.uint8).reshape(-1, 4)
        rows[part, 8:] = np.frombuffer(pa.decompress(r["rows"], r["count"] * WIDTH, codec="zstd"), np.uint8).reshape(
            -1, WIDTH)
        start += r["count"]
    least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in parts])
    bits = earlier(rows, least)
    cuts = np.cumsum([r["count"] for r in parts])[:-1]
    return pa.table({"chunk": pa.array([r["chunk"] for r in parts], pa.int64()),
                     "bucket": pa.array([r["bucket"] for r in parts], pa.int32()),
                     "bits": pa.array([x.tobytes() for x in np.split(bits, cuts)], pa.binary())})


def spans_of(sent: Sent, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end (in the chunk) of the maximal covered runs.

    A document that is not the chunk's smallest with a segment has an earlier one for all its passages.
    """
    own = bits[sent.number] if len(bits) else np.empty(0, np.uint32)
    own = np.where(sent.document > sent.least[sent.number], np.uint32((1 << SPREAD) - 1), own) if len(own) else own
    set_ = ((own[:, None] >> np.arange(SPREAD, dtype=np.uint32)) & 1).astype(bool)
    set_ &= np.arange(SPREAD) < sent.counts[:, None]
    row, place = np.nonzero(set_)
    at, owner = sent.starts[row] + place, sent.owner[row]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    if not len(at):
        return owner, at, at
    new = np.concatenate(([True], (at[1:] > at[:-1] + LENGTH) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], at[last] + LENGTH


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            chunk = Chunk(r)
            if r["tokens"]:
                sent = chunk.repeated(_joined(r["tokens"]))
                parts = sorted(r["bits"], key=lambda x: x["bucket"])
                owner, start, end = spans_of(sent, np.frombuffer(b"".join(x["bits"] for x in parts), np.uint32))
            else:
                owner = start = end = np.empty(0, np.int64)
            begins = np.concatenate(([0], chunk.ends[:-1])) if len(chunk.ends) else chunk.ends
            cuts = np.searchsorted(owner, np.arange(len(chunk.ends) + 1))
            out, data = [], chunk.data.tobytes()
            for i, (low, high) in enumerate(zip(begins.tolist(), chunk.ends.tolist())):
                spans = list(zip(start[cuts[i]:cuts[i + 1]].tolist(), end[cuts[i]:cuts[i + 1]].tolist()))
                kept, at = [], low
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:high])
                out.append((int(chunk.ids[i]) if chunk.present[i] else None, high - low,
                            [{"start": a - low, "end": b - low} for a, b in spans], b"".join(kept)))
            for low in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out[low:low + 256]), (pa.int64(), pa.int64(), _SPANS,
                                                                               pa.binary()))],
                    names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the bytes that a passage of ``LENGTH`` bytes of an earlier document covers.

    Returns per row: doc_id, n_bytes, spans (maximal removed runs in bytes, end exclusive) and kept (the other
    bytes, in order; a cut may fall within a character).

    Cases: a null text is empty; a text shorter than a passage is kept; rows that share an id do not take from
    each other; a row with a null id keeps all its bytes and takes from none; other columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    buckets = min(65_536, max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = stored(source.mapInArrow(_packed, PACKED), "chunks")
    hot = stored(chunks.mapInArrow(_token_rows(buckets), "bucket int, chunk long, low binary, high binary, several binary")
                 .groupBy("bucket").applyInArrow(_count_tokens, "chunk long, tokens binary"), "hot-tokens")
    splitters = _splitters(hot, buckets)
    own = chunks.join(hot.groupBy("chunk").agg(F.collect_list("tokens").alias("tokens")).hint("merge"), "chunk", "left")
    verdicts = (own.where("tokens is not null").mapInArrow(_send(splitters), SENT)
                .groupBy("bucket").applyInArrow(_sort_bucket, "chunk long, bucket int, bits binary")
                .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")))
    return own.join(verdicts.hint("merge"), "chunk", "left").mapInArrow(_cut, RESULT)


def _splitters(hot: DataFrame, buckets: int) -> np.ndarray:
    """Bucket boundaries at quantiles of a sample of the repeated leading tokens."""
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("tokens").to_pylist():
                tokens = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(tokens[mix(tokens.view("<u8")) % np.uint64(64) == 0])],
                                                 names=["token"])

    sample = hot.mapInArrow(some, "token long")
    size = sample.count()
    draw = F.pmod(F.xxhash64("token", F.lit("splitter")), F.lit(1_000_003)) / 1_000_003
    rows = sample.where(draw < SPLITTER_SAMPLE / max(1, size)).collect()
    tokens = np.sort(np.array([r.token for r in rows], np.int64).view(np.uint64))
    if not len(tokens):
        return tokens
    return np.unique(tokens[(np.arange(1, buckets) * len(tokens)) // buckets])


def digest(removed: DataFrame) -> DataFrame:
    """Counts and the hash of what is kept."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
