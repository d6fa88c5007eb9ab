"""Stretches of a text that repeat one phrase over and over, found by dyadic square catching.

Once a document has 2^j words more, the block of those words is complete and gets a
catcher. Every later word ends a stretch of 2^j words, which is held against the
catchers whose block starts one possible period before it: periods from 2^j up to the
next power of two belong to blocks of 2^j words, so that a stretch meets one catcher of
each level. Equal words there are a square to be; it is grown both ways as far as the
words repeat, squares of one period that touch are one stretch, and stretches that
repeat often enough are the runs.

A run of period q, three times repeated, holds an aligned block of the level of q with
its repetition, so no run is missed. Stretches of 2^j words are compared by exact names:
the name of a stretch is the number of the pair of names of its halves. The comparisons
of all words of a group of documents are taken at once, level by level.

A document is judged where it lies; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_groups

#: A run has at least so many words, and so many periods (3 at least, which catching relies on).
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the smallest blocks; periods up to twice as many belong to them.
SMALLEST = 8
#: Text bytes of a group of documents.
GROUP = 3_000_000


class Words:
    """Numbered words of several documents one after the other, and names of their stretches of 2^j words."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray):
        ends = np.cumsum(sizes)
        self.start, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # words, name at each place (-1: none), places
        names, places, width = numbers.astype(np.int64), np.arange(len(numbers)), 1
        while len(places):
            self.levels.append((width, names, places))
            # A longer stretch is of use where its document holds a run of such a period.
            room = (places + 2 * width <= self.end[places]) & (
                self.end[places] - self.start[places] >= LEAST_PERIODS * 2 * width)
            places = places[room]
            pair = names[places] * (int(names.max(initial=0)) + 1) + names[places + width]
            names = np.full(len(numbers), -1, np.int64)
            names[places] = pd.factorize(pair)[0]
            width *= 2

    def grown(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place around ``at`` of words that equal the one a period later."""
        first, last = at.copy(), at.copy()
        begin, end = self.start[at], self.end[at]
        size = len(self.start)
        for width, names, _ in reversed(self.levels):
            live = np.arange(len(at))
            while len(live):
                x = last[live]
                fits = x + period[live] + width <= end[live]
                far = np.minimum(x + period[live], size - 1)
                fits &= (names[np.minimum(x, size - 1)] == names[far]) & (names[far] >= 0)
                live = live[fits]
                last[live] += width
            live = np.arange(len(at))
            while len(live):
                x = first[live] - width
                fits = x >= begin[live]
                x = np.maximum(x, 0)
                fits &= (names[x] == names[x + period[live]]) & (names[x] >= 0)
                live = live[fits]
                first[live] -= width
        return first, last


def _caught(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods at which a catcher meets its block again; of blocks in a row, the first."""
    places_out, periods_out = [], []

    def watch(width: int, names: np.ndarray, at: np.ndarray, block: np.ndarray) -> None:
        fits = (block >= words.start[at]) & (block < at)
        at, block = at[fits], block[fits]
        same = names[at] == names[block]
        at, block = at[same], block[same]
        if not len(at):
            return
        period = at - block
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        new = np.append(True, (np.diff(period) != 0) | (np.diff(block) != width) | (
            words.start[block[1:]] != words.start[block[:-1]]))
        places_out.append(block[new])
        periods_out.append(period[new])

    for width, names, at in words.levels:
        own = at - words.start[at]
        if width == SMALLEST:
            nearest = (own - 1) // width * width
            watch(width, names, at, words.start[at] + nearest)
            watch(width, names, at, words.start[at] + nearest - width)
        elif width > SMALLEST:
            watch(width, names, at, words.start[at] + (own // width - 1) * width)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(places_out or empty), np.concatenate(periods_out or empty)


def find_runs(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and period of the runs of documents that lie one after the other, by place and period."""
    words = Words(numbers, sizes)
    at, period = _caught(words)
    first, last = words.grown(at, period)
    length = last - first + period
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    first, length, period = first[keep], length[keep], period[keep]
    # One stretch may be caught by several blocks and, at a multiple, by larger periods: the smallest is its own.
    order = np.lexsort((period, length, first))
    first, length, period = first[order], length[order], period[order]
    new = np.append(True, (np.diff(first) != 0) | (np.diff(length) != 0))[:len(first)]
    first, length, period = first[new], length[new], period[new]
    order = np.lexsort((period, first))
    return first[order], length[order], period[order]


def _judged(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text", GROUP):
            each = [(x or b"").split() for x in texts]
            sizes = np.array([len(x) for x in each], np.int64)
            every = np.empty(int(sizes.sum()), object)
            every[:] = [w for x in each for w in x]
            starts = np.cumsum(sizes) - sizes
            first, length, period = find_runs(pd.factorize(every)[0], sizes)
            gone = np.zeros(len(every) + 1, np.int64)
            np.add.at(gone, first + period, 1)
            np.add.at(gone, first + length, -1)
            stays = np.cumsum(gone)[:-1] == 0
            doc = np.searchsorted(starts, first, side="right") - 1
            # An empty document starts where the next one does: the last of those has the words.
            many = np.bincount(doc, minlength=len(each))
            shown = [b" ".join(x) if not m else b" ".join(every[a:a + n][stays[a:a + n]])
                     for x, m, a, n in zip(each, many, starts, sizes)]
            found = pa.StructArray.from_arrays(
                [pa.array(first - starts[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
            made = {"n_words": pa.array(sizes), "runs": pa.ListArray.from_arrays(offsets, found),
                    "collapsed": pa.array(shown, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays(
                [made[f.name].cast(f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)
    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed, and ``keep``.

    Words are what lies between ASCII white space. A run is a stretch of LEAST_WORDS words and LEAST_PERIODS
    periods at least that no neighbour prolongs, with its smallest period. ``collapsed`` has the words that no run
    repeats, with one space between them.

    Cases: a null or empty text has no words, no runs and an empty ``collapsed``; repeated rows and null ids are judged row
    by row; runs that overlap are all returned; a text of any length is handled whole, in memory of some ten numbers
    per word and level; a column of ``keep`` named like a result is refused; other columns are ignored; an empty table
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    clash = {"doc_id", "text", "n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"keep has names of results: {sorted(clash)}")
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *keep)
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    shape = StructType([source.schema["doc_id"], StructField("n_words", LongType()),
                        StructField("runs", ArrayType(run)), StructField("collapsed", StringType()),
                        *(source.schema[c] for c in keep)])
    return source.mapInArrow(_judged(to_arrow_schema(shape)), shape)


def strongest(runs: Column) -> Column:
    """The run with most periods (an exact fraction), the first of equals; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(
        x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """Numbers and fingerprints of the rows of ``periodic_runs``."""
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = strongest(F.col("runs"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_repetitions(docs: DataFrame) -> DataFrame:
    """``documents`` of the registered query: a tenth of them, by a checksum of the id, repeats a phrase to its end.

    With h = crc32 of the id's text and g = h / 10, a document of n words with h % 10 = 0 goes on, from word a = g % n,
    with the p = 1 + (n - a) / (3 + g % 8) words from there, again and again.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"),
                         F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("_words"))
    n = F.size("_words")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    marked = marked.withColumn("_a", F.when(n > 0, a).cast("int")).withColumn("_p", F.when(n > 0, p).cast("int"))
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(
        i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return marked.select("doc_id", F.when(F.col("_a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
