"""Quality of documents by a convolutional network over their bytes, in numpy.

A text is cut into overlapping chunks that cover it whole; neighbours share a filter's
width less one byte, so every window of bytes lies in a chunk. Bytes have learned
vectors, learned filters slide over each chunk, and a chunk keeps every filter's largest
response. A document is the mean and the largest of its chunks' responses, which a
logistic unit turns into one probability.

Training is stochastic gradient descent on a bounded sample of judged rows, dealt to a
few tasks: in every round each task steps over its part from the shared weights, and the
weights are averaged. The sample holds both classes alike; the bias is set back to the
share of each class among all learning rows. Scoring is one pass over whole texts where
they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_groups

WIDTH, FILTERS, VECTOR = 6, 16, 8
#: Windows of a chunk; a chunk has WIDTH - 1 bytes more.
WINDOWS = 256
#: Chunks that are in memory at once.
SLAB = 512
#: Rows of each class in the training sample at most.
SAMPLE = 1500
PARTS, ROUNDS, PASSES, BATCH, RATE, DECAY = 4, 4, 3, 16, 0.01, 1e-4
THRESHOLD = 0.3


@dataclass
class Network:
    """``vectors`` of bytes, ``filters`` (place x vector x filter) with ``offsets``, ``weights`` of means and maxima, ``bias``."""

    vectors: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        return cls(draw.normal(0, 0.5, (256, VECTOR)), draw.normal(0, 1 / (WIDTH * VECTOR) ** 0.5, (WIDTH, VECTOR, FILTERS)),
                   np.zeros(FILTERS), draw.normal(0, 0.1, 2 * FILTERS), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offsets, self.weights, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        shapes = [p.shape for p in cls.fresh().parts()]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return cls(*(x.reshape(s).copy() for x, s in zip(np.split(flat, cuts), shapes)))

    def tables(self) -> np.ndarray:
        """Response of each filter place to each byte."""
        return np.einsum("bv,kvf->kbf", self.vectors, self.filters).astype(np.float32)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk in the joined texts (each filled up with zero bytes to one chunk at least), and its document."""
    size = WINDOWS + WIDTH - 1
    lengths = np.array([max(len(t), size) for t in texts], np.int64)
    many = 1 + -(-(lengths - size) // WINDOWS)
    doc = np.repeat(np.arange(len(texts)), many)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    # The last chunk ends where the text does, and overlaps the one before as far as it must.
    start = np.minimum(turn * WINDOWS, lengths[doc] - size) + (np.cumsum(lengths) - lengths)[doc]
    return start, doc


def responses(tables: np.ndarray, offsets: np.ndarray, texts: list[bytes], places: bool = False):
    """Largest response of every filter in every chunk, the chunks' documents, and for ``places`` the bytes under the
    window that it came from (chunk x filter x place)."""
    size = WINDOWS + WIDTH - 1
    joined = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), np.uint8)
    start, doc = chunks(texts)
    out = np.empty((len(start), tables.shape[2]), np.float32)
    under = np.empty((*out.shape, WIDTH), np.uint8) if places else None
    for first in range(0, len(start), SLAB):
        at = start[first:first + SLAB]
        cut = joined[at[:, None] + np.arange(size)]
        index = cut.astype(np.intp)
        total = tables[0][index[:, :WINDOWS]]
        for k in range(1, WIDTH):
            total += tables[k][index[:, k:k + WINDOWS]]
        if places:
            best = total.argmax(axis=1)
            out[first:first + SLAB] = np.take_along_axis(total, best[:, None, :], 1)[:, 0]
            rows = np.arange(len(at))[:, None, None]
            under[first:first + SLAB] = cut[rows, best[:, :, None] + np.arange(WIDTH)]
        else:
            out[first:first + SLAB] = total.max(axis=1)
    out += offsets.astype(np.float32)
    return out, doc, under


def pooled(responded: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and largest chunk response (after tanh) of each document, and which chunk had the largest."""
    h = np.tanh(responded.astype(np.float64))
    first = np.searchsorted(doc, np.arange(documents))
    many = np.diff(np.append(first, len(doc)))
    mean = np.add.reduceat(h, first) / many[:, None]
    top = np.maximum.reduceat(h, first)
    # The first chunk with the largest response.
    rank = np.where(h == top[doc], np.arange(len(doc))[:, None], len(doc))
    return np.hstack([mean, top]), np.minimum.reduceat(rank, first)


def probabilities(net: Network, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
    responded, doc, _ = responses(net.tables() if tables is None else tables, net.offsets, texts)
    z = pooled(responded, doc, len(texts))[0] @ net.weights + net.bias[0]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradient(net: Network, texts: list[bytes], good: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log loss of some documents and its slope in all weights."""
    responded, doc, under = responses(net.tables(), net.offsets, texts, places=True)
    features, top = pooled(responded, doc, len(texts))
    z = features @ net.weights + net.bias[0]
    loss = float(np.mean(np.logaddexp(0, z) - good * z))
    dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - good) / len(texts)
    many = np.bincount(doc, minlength=len(texts))
    dh = (dz / many)[doc, None] * net.weights[:FILTERS]
    np.add.at(dh, (top, np.arange(FILTERS)[None, :]), dz[:, None] * net.weights[FILTERS:])
    du = dh * (1 - np.tanh(responded.astype(np.float64)) ** 2)
    # A chunk's response reaches only the bytes of the window it came from.
    d_tables = np.empty((WIDTH, 256, FILTERS))
    column = np.arange(FILTERS)
    for k in range(WIDTH):
        cell = under[:, :, k].astype(np.int64) * FILTERS + column
        d_tables[k] = np.bincount(cell.ravel(), du.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    d_vectors = np.einsum("kbf,kvf->bv", d_tables, net.filters)
    d_filters = np.einsum("kbf,bv->kvf", d_tables, net.vectors)
    return loss, np.concatenate([d_vectors.ravel(), d_filters.ravel(), du.sum(axis=0), features.T @ dz, [dz.sum()]])


class Steps:
    """Adam steps over mini-batches."""

    def __init__(self, size: int):
        self.first, self.second, self.t = np.zeros(size), np.zeros(size), 0

    def take(self, flat: np.ndarray, slope: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope ** 2
        ahead = self.first / (1 - 0.9 ** self.t) / (np.sqrt(self.second / (1 - 0.999 ** self.t)) + 1e-8)
        return flat - rate * (ahead + DECAY * flat)


def train(flat: np.ndarray, texts: list[bytes], good: np.ndarray, rate: float, seed: int, passes: int = PASSES) -> np.ndarray:
    """Weights after some passes over documents, in a drawn order."""
    draw, steps = np.random.default_rng(seed), Steps(len(flat))
    for _ in range(passes):
        order = draw.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            at = order[start:start + BATCH]
            _, slope = gradient(Network.of(flat), [texts[i] for i in at], good[at])
            flat = steps.take(flat, slope, rate)
    return flat


@dataclass
class Model:
    """A network, whose bias includes the classes' shares."""

    net: Network


def _round(flat: np.ndarray, rate: float, seed: int):
    """One task's part: its rows, the weights after its passes, and how many rows it had."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, good = [], []
        for batch in batches:
            texts += [x.encode() if x else b"" for x in batch.column("text").to_pylist()]
            good += batch.column("good").to_pylist()
        if texts:
            # The rows' order in a file is not relied on.
            order = sorted(range(len(texts)), key=lambda i: (texts[i], good[i]))
            new = train(flat, [texts[i] for i in order], np.array(good, float)[order], rate, seed)
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([new.tobytes()], pa.binary())],
                                             names=["n", "weights"])
    return run


def learn(docs: DataFrame, labels: DataFrame, learning: Column, id_column: str = "doc_id", text: str = "text",
          quality: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the judged rows that ``learning`` marks; at most about ``sample`` rows of each class are trained on.

    Labels of one id are taken together (1 if any is 1); null labels and null ids teach nothing; without a row of either class
    every score is the share of good rows (one half without any).
    """
    judged = labels.where(learning & F.col(quality).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        id_column).agg(F.max((F.col(quality) == 1).cast("int")).alias("good"))
    judged = stored(judged, "judged")
    counts = {r["good"]: r["count"] for r in judged.groupBy("good").count().collect()}
    net = Network.fresh()
    bad, good = counts.get(0, 0), counts.get(1, 0)
    odds = float(np.log((good + 0.5) / (bad + 0.5)))
    if not bad or not good:
        net.weights[:] = 0
        net.bias[:] = odds if bad or good else 0.0
        return Model(net)
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("quality sample")), F.lit(1_000_003)) / 1_000_003
    most = F.when(F.col("good") == 1, min(1.0, sample / good)).otherwise(min(1.0, sample / bad))
    chosen = judged.where(draw < most)
    # Few rows: their ids go to the documents, and a document that occurs often is one row.
    rows = (docs.select(F.col(id_column), F.col(text).alias("text")).join(F.broadcast(chosen), id_column)
            .groupBy(id_column).agg(F.first("good").alias("good"), F.min("text").alias("text")))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.col(id_column), F.lit("part")), F.lit(PARTS)))
    kept = stored(dealt.select("part", "good", "text"), "quality-sample")
    flat = net.flat()
    sums = [{r["good"]: r["count"] for r in kept.groupBy("good").count().collect()}][0]
    if not sums.get(0) or not sums.get(1):
        return Model(net)
    for turn in range(ROUNDS):
        rate = RATE * (1 - turn / ROUNDS)
        dealt = kept.repartition(PARTS, "part").select("text", "good")
        back = dealt.mapInArrow(_round(flat, rate, turn), "n long, weights binary").collect()
        back.sort(key=lambda r: (r.n, bytes(r.weights)))
        flat = sum(r.n * np.frombuffer(r.weights) for r in back) / sum(r.n for r in back)
    net = Network.of(flat)
    net.bias += odds - float(np.log((sums[1] + 0.5) / (sums[0] + 0.5)))
    return Model(net)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted (score of at least ``threshold``) of every row.

    Cases: a null or empty text is one chunk of zero bytes; repeated rows and null ids are judged row by row; a text of any
    length is scored whole, in slabs of SLAB chunks; other columns are ignored; an empty table gives no rows.
    """
    tables = model.net.tables()
    net = model.net

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text"):
            got = probabilities(net, [x or b"" for x in texts], tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
