"""Toxic documents by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the other text is unlabelled, since
most of it was never judged. A linear classifier over hashed character runs of
words minimises the class-prior-corrected risk, whose part for the negatives is
kept from going below zero: where it would, the step goes the other way.

Which runs the classifier sees is decided by counts over all learning rows
(occurrence among positives against occurrence in all text), added up in the
tasks; at most ``FEATURES`` of them are kept. The classifier itself is fitted on
a sample of bounded size. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_groups

BUCKETS = 1 << 20
#: A bucket is one feature for each of these numbers of distinct words that it occurs in.
LEVELS = (1, 2, 4)
TOTAL = BUCKETS * len(LEVELS)
FEATURES = 4096
#: A run is a feature if this many positives hold it at least (number, share of all), its standard score
#: is high, and the class prior makes a document with it alone this likely to be toxic.
LEAST_POSITIVES, LEAST_SHARE, LEAST_SCORE, LEAST_POSTERIOR = 4, 0.01, 6.0, 0.3
#: Ids of positives are broadcast if they were counted and are at most so many.
BROADCAST_ROWS = 1_000_000
#: Rows of the sample at most.
POSITIVES, UNLABELLED = 4000, 12000
_ALNUM = np.fromiter((chr(i).isalnum() for i in range(0x10000)), bool, 0x10000)


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of whole words and of the runs of 5 and 7 characters in them (word ends included), and the
    hash of the word that each is in; with repeats."""
    p = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = (p > 0xFFFF) | _ALNUM[np.minimum(p, 0xFFFF)]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    p = np.where(inside, p, np.uint32(32)).astype(np.uint32)
    first = np.flatnonzero(~inside[at - 1])
    sizes = np.diff(np.append(first, len(at)))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(sizes.max()), np.uint32(0x27D4EB2F)))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        words = np.add.reduceat((p[at] * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)) * powers[place], first,
                                dtype=np.uint32)
        word_at = np.zeros(len(p), np.uint32)
        word_at[at] = np.repeat(words, sizes)
        hashes, owners = [words], [words]
        hashed, clear = p, np.ones(len(p), bool)
        for n in range(2, 8):
            # A run starts anywhere and holds no gap but at its ends.
            hashed = hashed[:-1] * np.uint32(0x9E3779B1) + p[n - 1:] * np.uint32(0x85EBCA77)
            clear = clear[:-1] & inside[n - 2:-1] if n > 2 else clear[:-1]
            if n in (5, 7):
                keep = np.flatnonzero(clear)
                hashes.append(hashed[keep] + np.uint32(n))
                owners.append(word_at[keep + 1])
        h = np.concatenate(hashes)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((h ^ (h >> np.uint32(13))) >> np.uint32(12)).astype(np.int64), np.concatenate(owners)


def levels(buckets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Features: a bucket that occurs, and again (by its offset) if it does in several distinct words."""
    pairs = np.unique((buckets.astype(np.uint64) << np.uint64(32)) | words)
    found, counts = np.unique(pairs >> np.uint64(32), return_counts=True)
    found = found.astype(np.int64)
    return np.concatenate([found[counts >= least] + BUCKETS * i for i, least in enumerate(LEVELS)])


@dataclass
class Model:
    """``number`` of each feature (-1: not seen by the classifier), a weight for each number, and a bias."""

    number: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.wanted = (self.number[:-1].reshape(len(LEVELS), BUCKETS) >= 0).any(axis=0)

    def seen(self, text: str) -> np.ndarray:
        """Numbers of the features that occur in a text."""
        buckets, words = runs(text)
        keep = self.wanted[buckets]
        got = self.number[levels(buckets[keep], words[keep])]
        return got[got >= 0]

    def score(self, text: str) -> float:
        z = float(self.weights[self.seen(text)].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _counted(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``bucket`` and ``n``: in how many of the rows each feature (of ``wanted``, if given) occurs; their own number
    is at bucket TOTAL. A task adds up all its rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TOTAL + 1, np.int64)
        for _, texts in text_groups(batches, "text"):
            for text in texts:
                seen[levels(*runs((text or b"").decode()))] += 1
                seen[TOTAL] += 1
        at = np.flatnonzero(seen if wanted is None else seen * np.append(wanted, True))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bounded_prior(prior: float, shares: list[tuple[float, float]], n_positive: int) -> float:
    """The class prior, or the least that the features leave room for, if that is less.

    ``shares`` has each feature's share of all rows and of the positives. The positives among all rows have a feature
    as often as the known ones do, so its share of all rows is at least the prior times its share of the positives. What
    chance may add to the latter (two standard errors) is taken off first.
    """
    for share, own in shares:
        sure = own - 2 * (own * (1 - own) / n_positive) ** 0.5
        if sure > 0:
            prior = min(prior, share / sure)
    return prior


def association(rows: DataFrame, positives: DataFrame, prior: float) -> tuple[dict[int, float], int, int, float]:
    """Standard scores of the features that go with the positives, how many positives and rows there are, and
    the class prior that the features leave room for.

    The positives are counted first; then all rows, but only for features that enough positives have. At most
    TOTAL numbers (its size is fixed) reach the driver.
    """
    first = _counted(positives, None)
    n_positive = (first.where(F.col("bucket") == TOTAL).first() or {"n": 0})["n"]
    if not n_positive:
        return {}, 0, 0, prior
    least = max(LEAST_POSITIVES, LEAST_SHARE * n_positive)
    among = {r["bucket"]: r["n"] for r in first.where((F.col("n") >= least) & (F.col("bucket") < TOTAL)).collect()}
    wanted = np.zeros(TOTAL, bool)
    wanted[list(among)] = True
    everywhere = {r["bucket"]: r["n"] for r in _counted(rows, wanted).collect()}
    n_rows = everywhere.pop(TOTAL)
    prior = bounded_prior(prior, [(n / n_rows, among[b] / n_positive) for b, n in everywhere.items()], n_positive)
    scores = {}
    for bucket, n in everywhere.items():
        share, own = n / n_rows, among[bucket] / n_positive
        score = (own - share) / (share * (1 - share) / n_positive + 1e-12) ** 0.5
        if prior * own >= LEAST_POSTERIOR * share and score >= LEAST_SCORE:
            scores[bucket] = score
    best = sorted(scores, key=lambda b: (-scores[b], b))[:FEATURES]
    return {b: scores[b] for b in best}, n_positive, n_rows, prior


def risk_parts(w: np.ndarray, b: float, at: np.ndarray, row: np.ndarray, is_p: np.ndarray,
               prior: float) -> tuple[float, float, np.ndarray]:
    """The risk's part for the positives, that for the negatives, and the slope of a step in each row's response: of
    their sum or, where the latter is below zero, against it. ``at`` and ``row`` are the cells of the sparse rows."""
    n_p, n_u = max(1, int(is_p.sum())), max(1, int((~is_p).sum()))
    z = np.bincount(row, w[at], len(is_p)) + b
    sigma = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    up = np.where(is_p, np.logaddexp(0, z), 0).sum() / n_p  # loss of positives as negatives
    negative = np.where(is_p, 0, np.logaddexp(0, z)).sum() / n_u - prior * up
    positive = prior * np.where(is_p, np.logaddexp(0, -z), 0).sum() / n_p
    as_positive = np.where(is_p, prior * (sigma - 1) / n_p, 0)
    as_negative = np.where(is_p, -prior * sigma / n_p, sigma / n_u)
    return float(positive), float(negative), as_positive + as_negative if negative >= 0 else -as_negative


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 600,
        rate: float = 0.05, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk over sparse rows, by Adam steps over the whole sample.

    Of all steps, the weights of the least risk are returned: a step against a risk below zero can lead astray.
    """
    rows = positives + unlabelled
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    is_p = np.arange(len(rows)) < len(positives)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    least, best = np.inf, (w, b)
    for t in range(1, steps + 1):
        positive, negative, slope = risk_parts(w, b, at, row, is_p, prior)
        risk = positive + abs(negative) + l1 * np.abs(w).sum()
        if risk < least:
            least, best = risk, (w, b)
        gradient = np.append(np.bincount(at, slope[row], size) + l1 * np.sign(w), slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        step = rate * first / (1 - 0.9 ** t) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return best


def learn(docs: DataFrame, labels: DataFrame, learning: Column, id_column: str = "doc_id", text: str = "text",
          toxic: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the rows that ``learning`` marks; only toxic = 1 counts as a label, the rest is unlabelled.

    The class prior is the share of toxic rows among the judged ones, or less where the text of all learning rows
    shows that the judged ones are richer (``bounded_prior``).
    """
    judged = labels.where(learning & F.col(toxic).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        id_column).agg(F.max(toxic).alias("_toxic"))
    share = judged.agg(F.avg((F.col("_toxic") == 1).cast("double")).alias("p")).first().p or 0.0
    prior = min(0.9, max(1e-4, share))
    toxic_ids = stored(judged.where("_toxic = 1").select(id_column, F.lit(True).alias("_marked")), "toxic-ids")
    # Texts are shuffled only if there are too many positives to send their ids to every task.
    few = toxic_ids.count() <= BROADCAST_ROWS
    rows = (docs.select(F.col(id_column), F.col(text).alias("text")).where(learning)
            .join(F.broadcast(toxic_ids) if few else toxic_ids, id_column, "left")
            .select(id_column, "text", F.coalesce("_marked", F.lit(False)).alias("positive")))
    scores, n_positive, n_rows, prior = association(rows, rows.where("positive"), prior)
    number = np.full(TOTAL + 1, -1, np.int32)
    number[list(scores)] = np.arange(len(scores))
    if not scores:
        return Model(number, np.zeros(0), -20.0)
    draw = F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    most = F.when(F.col("positive"), min(1.0, positives / n_positive)).otherwise(0.0)
    base = Model(number, np.zeros(len(scores)), 0.0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text"):
            got = [base.seen((x or b"").decode()).astype("<i4").tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), pa.array(got, pa.binary())],
                                             names=["p", "u", "at"])

    # A toxic row may be in both parts: the unlabelled part is drawn from all text.
    chosen = rows.select("text", (draw < most).alias("p"), (draw < min(1.0, unlabelled / n_rows)).alias("u"))
    got = chosen.where("p or u").mapInArrow(pick, "p boolean, u boolean, at binary").collect()
    parts = [sorted((np.frombuffer(r.at, "<i4") for r in got if r[kind]), key=lambda x: x.tobytes())
             for kind in ("p", "u")]
    w, b = fit(*parts, len(scores), prior)
    return Model(number, w, b)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of at least one half) of every row.

    Cases: a null or empty text has no features and gets the score of the bias; repeated rows and null
    ids are judged one by one; other columns are ignored; an empty table gives no rows; without any
    positive to learn from, every score is next to 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text"):
            got = np.array([model.score((x or b"").decode()) for x in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
