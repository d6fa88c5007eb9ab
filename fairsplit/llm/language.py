"""Language of documents by sparse multinomial logistic regression.

Features are hashed character pairs and triples of the lower-cased text, with
everything that is no letter as one space, weighted by term and inverse document
frequency. Document frequencies are counted over all learning rows, in the
tasks, as one vector per task. The classifier is trained with
follow-the-regularised-leader and an elastic-net penalty on a sample of bounded
size per label, then its temperature is fitted on a part of the sample that the
training does not see. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups

BUCKETS = 1 << 15
#: Learning rows per label at most, and the part of them that fits the temperature.
SAMPLE_PER_LABEL = 1500
CALIBRATION_SHARE = 0.2
UNKNOWN = "und"
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one space; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        letter[high] = [chr(x).isalpha() for x in points[high].tolist()]
    if not letter.any():
        return points[:0]
    points = np.where(letter, points, np.uint32(32))
    padded = np.concatenate(([32], points, [32])).astype(np.uint32)
    return padded[np.concatenate(([True], (padded[1:] != 32) | (padded[:-1] != 32)))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and counts of a text's character pairs and triples."""
    p = letters_of(text)
    if not len(p):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = p[:-1] * np.uint32(0x9E3779B1) + p[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + p[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
        both = np.concatenate((pairs, triples))
        both = ((both ^ (both >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    if len(both) > BUCKETS // 4:
        counts = np.bincount(both, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return at, counts[at]
    return np.unique(both, return_counts=True)


@dataclass
class Model:
    """Weights (bucket x label) of weighted, normalised features; ``labels`` in sorted order."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        """Label and calibrated probability; ``und`` and 0 without a letter or any learned label."""
        at, counts = features(text)
        if not len(at) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        return self.labels[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many non-empty texts each bucket occurs, over all rows; one row per bucket reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for _, texts in text_groups(batches, "text"):
            for x in texts:
                at = features(x.decode())[0] if x else ()
                if len(at):
                    seen[at] += 1
                    rows += 1
        seen[BUCKETS] = rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    counted = (docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(BUCKETS + 1, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out[:BUCKETS], int(out[BUCKETS])


def sample(learning: DataFrame, id_column: str, text: str, label: str,
           per_label: int) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Features of about ``per_label`` rows of each label, chosen by a hash of the id; and who calibrates."""
    sizes = {r[label]: r["count"] for r in learning.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for name, size in sizes.items():
        share = F.when(F.col(label) == name, min(1.0, per_label / size)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    chosen = learning.where(draw < share).select(
        F.col(label).alias("label"), F.col(text).alias("text"),
        (F.pmod(F.xxhash64(F.col(id_column), F.lit("calibrate")), F.lit(1000)) < 1000 * CALIBRATION_SHARE).alias("c"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text"):
            got = [features((x or b"").decode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("c"),
                 pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()),
                 pa.array([n.astype("<i4").tobytes() for _, n in got], pa.binary())], names=["label", "c", "at", "n"])

    rows = chosen.mapInArrow(pick, "label string, c boolean, at binary, n binary").collect()
    out = [(r.label, np.frombuffer(r.at, "<i4"), np.frombuffer(r.n, "<i4"), r.c) for r in rows]
    return sorted((x for x in out if len(x[1])), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], idf: np.ndarray, passes: int = 3,
          rate: float = 0.3, smooth: float = 1.0, l1: float = 0.002, l2: float = 0.5, seed: int = 7) -> Model:
    """Per-coordinate FTRL-proximal steps over the sample, then the temperature."""
    labels = sorted({r[0] for r in rows})
    model = Model(labels, idf, np.zeros((len(idf), len(labels))), np.zeros(len(labels)))
    if not labels:
        return model
    fit = [r for r in rows if not r[3]] or rows
    z, n = np.zeros((len(idf) + 1, len(labels))), np.zeros((len(idf) + 1, len(labels)))

    def weights(at):
        root = (smooth + np.sqrt(n[at])) / rate + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / root)

    vectors = [(np.append(at, len(idf)), np.append(model.vector(at, c), 1.0), labels.index(y)) for y, at, c, _ in fit]
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        for i in draw.permutation(len(vectors)):
            at, x, y = vectors[i]
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            gradient = x[:, None] * error
            step = (np.sqrt(n[at] + gradient ** 2) - np.sqrt(n[at])) / rate
            z[at] += gradient - step * w
            n[at] += gradient ** 2
    whole = weights(np.arange(len(idf) + 1))
    model.weights, model.bias = whole[:-1], whole[-1]
    held = [r for r in rows if r[3]]
    if held:
        logits = np.array([model.logits(at, c) for _, at, c, _ in held])
        right = np.array([labels.index(r[0]) for r in held])

        def loss(t):
            return -np.log(softmax(logits / t)[np.arange(len(right)), right] + 1e-300).mean()

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def learn(docs: DataFrame, learning: Column, id_column: str = "doc_id", text: str = "text", label: str = "lang",
          per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model from the rows that ``learning`` marks and that have a label."""
    rows = docs.where(learning & F.col(label).isNotNull())
    frequency, total = document_frequencies(rows, text)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    return train(sample(rows, id_column, text, label, per_label), idf)


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of every row, or the columns of ``keep`` with lang_pred and score.

    Cases: a null text, an empty one and one without letters are ``und`` with score 0; repeated rows and
    null ids are judged one by one; other columns are ignored; an empty table gives no rows; a model of
    no labels predicts ``und``.
    """
    source = docs.select(*keep) if keep else docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    names = list(keep) or ["doc_id"]
    column = text if keep else "text"
    if column not in source.columns:
        raise ValueError(f"keep must hold {column}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, column):
            got = [model.predict(x.decode()) if x else (UNKNOWN, 0.0) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double")
