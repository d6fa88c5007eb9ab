"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same shingle set collapse first. The others get a signature
of ``ORDERS`` x ``DEPTH`` minima, read as one label of ``DEPTH`` minima for each
of several orders. Each order is sorted over the cluster (range partitions, ties
by id, so that even a third of all rows with one label is dealt evenly), and a
row's candidates are its neighbours by longest common prefix. The depth adapts
to the region: where more than ``REGION`` rows share a prefix, one more minimum
is asked for, and so on; the nearest ``NEAREST`` neighbours are candidates at
any depth, and so are the two rows at the centre of a larger region. A small sketch discards candidates that are far from the threshold.

Links are confirmed on full shingle sets. Documents stream in order of their
candidate group, with a window of sets in memory and a union-find that skips
links between documents that are tied already; what the window misses is joined.

These candidates tie most of a large region, but not all of it. So every row that
shares ``START_DEPTH`` minima with more than ``REGION`` rows in any order is crowded,
and crowded rows that are not tied yet are joined exactly: a pair at the threshold
shares one of its rarest shingles, a number of them that its sizes determine.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, mix, stored, text_groups
from .components import components

SHINGLE = 2
ORDERS, DEPTH = 20, 8
START_DEPTH = 4
REGION, NEAREST = 12, 1
SKETCH = 64
#: Share of equal sketch bytes below which a pair is dropped: five standard deviations under 0.8.
SKETCH_FLOOR = 0.55
WINDOW_BYTES = 96_000_000
#: So many open pairs at most are all tested in one pass; of more, the best of each two components go first.
PAIRS_AT_ONCE = 20_000
#: Shingles of crowded documents are counted by this many hash values; the counts set an order only.
COUNTERS = 1 << 18
#: Fixed: A-Z become a-z; the white space that separates words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed place by place for all words.
LONG_WORD = 32
_FACTOR = _RANDOM.integers(0, 2**32, ORDERS * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 2**32, ORDERS * DEPTH, dtype=np.uint32)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more entry at the end)."""
    data = np.frombuffer(b"".join((x or b"") + b" " for x in texts).translate(LOWER), np.uint8)
    ends = np.cumsum([len(x or b"") + 1 for x in texts], dtype=np.int64)
    # Each text ends in a space, so words begin and end in turn.
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edges = np.concatenate(([0], edges))
    first, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # Longest first, so that the words that reach a place stand together; those beyond LONG_WORD are added up each.
    reach = np.minimum(lengths, LONG_WORD + 1)
    order = np.argsort((LONG_WORD + 1 - reach).astype(np.uint8), kind="stable")
    begins, sums = first[order], np.zeros(len(first), np.uint64)
    words = len(first) - np.cumsum(np.bincount(reach, minlength=LONG_WORD + 2))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _BASE))
        for place in range(min(LONG_WORD, len(powers))):
            sums[:words[place]] += (_BYTE * powers[place])[data[begins[:words[place]] + place]]
        if words[LONG_WORD]:
            sizes = lengths[order[:words[LONG_WORD]]] - LONG_WORD
            starts = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) - np.repeat(starts, sizes) + LONG_WORD
            at = np.repeat(begins[:len(sizes)], sizes) + place
            sums[:len(sizes)] += np.add.reduceat(_BYTE[data[at]] * powers[place], starts)
        hashes = np.empty(len(first), np.uint64)
        hashes[order] = mix(sums)
    return hashes, np.concatenate(([0], np.searchsorted(first, ends)))


def shingle_sets(texts: list[bytes | None], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: runs of ``width`` words, or all words if there are fewer."""
    words, begins = word_hashes(texts)
    # By length: the runs of so many words that begin at each word.
    runs = [words, mix(words)]
    with np.errstate(over="ignore"):
        for k in range(1, width):
            before = words if k == 1 else runs[k]
            runs.append(mix(before[:max(0, len(words) - k)] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(words[k:])))
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        size = min(width, end - start)
        yield np.unique(runs[size][start:end - size + 1]) if size else words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of ORDERS x DEPTH linear maps over a set of shingles."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTOR), 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(small), 512):
            np.minimum(out, (small[start:start + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=out)
    return out


def _signed(batches: Iterator[pa.RecordBatch], words: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    width = 2 * DEPTH
    for batch, texts in text_groups(batches, "text"):
        sizes, prints, sketches, labels = [], [], [], []
        for shingles in shingle_sets(texts, words):
            sizes.append(len(shingles))
            if not len(shingles):
                prints.append(None), sketches.append(None), labels.append(None)
                continue
            prints.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            minima = signature(shingles)
            sketches.append((minima[:SKETCH] >> np.uint32(16)).astype(np.uint8).tobytes())
            raw = (minima & np.uint32(0xFFFF)).astype(">u2").tobytes()
            labels.append([raw[i * width:(i + 1) * width] for i in range(ORDERS)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
             pa.array(sketches, pa.binary()), pa.array(labels, pa.list_(pa.binary()))],
            names=["doc_id", "n_shingles", "print", "sketch", "labels"])


def _centres(sketches: np.ndarray) -> np.ndarray:
    """The two rows that agree best with the most frequent value of each sketch byte."""
    common = np.array([np.bincount(column, minlength=256).argmax() for column in sketches.T])
    return np.argsort(-(sketches == common).sum(axis=1), kind="stable")[:2]


def _neighbours(orders: np.ndarray, labels: np.ndarray, sketches: np.ndarray,
                old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of sorted rows, and the crowded rows; of neighbours, only pairs whose later row is at least ``old``.

    In a region of more than REGION rows every row is also paired with the region's centres, at each depth:
    edited copies may be alike to their original only. Rows that are not crowded have all pairs of their region.
    """
    n = len(labels)
    same = np.zeros(n, np.int8)
    if n > 1:
        equal = (labels[1:] == labels[:-1]) & (orders[1:] == orders[:-1])[:, None]
        same[1:] = np.minimum.accumulate(equal, axis=1).sum(axis=1)
    need = np.full(n, DEPTH + 1, np.int8)
    left, right = [], []
    for depth in range(DEPTH, START_DEPTH - 1, -1):
        run = np.cumsum(same < depth)
        run -= run[0]
        sizes = np.bincount(run)
        need[sizes[run] <= REGION] = depth
        starts = np.cumsum(sizes) - sizes
        for start, size in zip(starts[sizes > REGION].tolist(), sizes[sizes > REGION].tolist()):
            for centre in (start + _centres(sketches[start:start + size])).tolist():
                others = np.arange(start, start + size)
                left.append(np.minimum(others, centre)[others != centre])
                right.append(np.maximum(others, centre)[others != centre])
    shared = np.full(n, DEPTH, np.int8)
    for step in range(1, min(REGION, n)):
        shared = np.minimum(shared[:-1], same[step:])
        wanted = (shared >= need[:n - step]) | ((shared >= START_DEPTH) if step <= NEAREST else False)
        at = np.flatnonzero(wanted)
        at = at[at + step >= old]
        left.append(at)
        right.append(at + step)
    none = np.empty(0, np.int64)
    crowded = np.flatnonzero(need > START_DEPTH)
    return (np.concatenate(left), np.concatenate(right), crowded) if left else (none, none, crowded)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among sorted rows, crowded rows (``kind`` 2), and those at both ends of the partition (1) for the next level.

    REGION rows are carried over, so that a region beyond the limit is seen to be so on both sides of a cut.
    """
    part = TaskContext.get().partitionId()
    keep = REGION
    ids, orders = np.empty(0, np.int64), np.empty(0, np.int32)
    labels, sketches = np.empty((0, DEPTH), ">u2"), np.empty((0, SKETCH), np.uint8)
    waiting: list[pa.RecordBatch] = []
    head: pa.Table | None = None

    def rows(kind: int, doc, order, label, sketch, b, score) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(doc, pa.int64()), pa.array(order, pa.int32()),
             pa.array(label, pa.binary()), pa.array(sketch, pa.binary()), pa.array(b, pa.int64()),
             pa.array(score, pa.float32())],
            names=["kind", "doc_id", "tree", "label", "sketch", "b", "score"])

    def work() -> Iterator[pa.RecordBatch]:
        nonlocal ids, orders, labels, sketches, waiting, head
        new = pa.Table.from_batches(waiting)
        waiting = []
        if head is None or len(head) < keep:
            head = new.slice(0, keep) if head is None else pa.concat_tables([head, new]).slice(0, keep)
        old = len(ids)
        ids = np.concatenate((ids, new["doc_id"].to_numpy()))
        orders = np.concatenate((orders, new["tree"].to_numpy()))
        labels = np.concatenate((labels, np.frombuffer(b"".join(new["label"].to_pylist()), ">u2").reshape(-1, DEPTH)))
        sketches = np.concatenate((sketches, np.frombuffer(b"".join(new["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)))
        left, right, crowded = _neighbours(orders, labels, sketches, old)
        blank = [None] * len(crowded)
        yield rows(2, ids[crowded], blank, blank, blank, blank, blank)
        for start in range(0, len(left), 65_536):
            i, j = left[start:start + 65_536], right[start:start + 65_536]
            score = (sketches[i] == sketches[j]).mean(axis=1)
            good = (score >= SKETCH_FLOOR) & (ids[i] != ids[j])
            a, b = np.minimum(ids[i], ids[j])[good], np.maximum(ids[i], ids[j])[good]
            blank = [None] * len(a)
            yield rows(0, a, blank, blank, blank, b, score[good].astype(np.float32))
        ids, orders, labels, sketches = ids[-keep:], orders[-keep:], labels[-keep:], sketches[-keep:]

    pending = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            pending += batch.num_rows
        if pending >= 32_768:
            yield from work()
            pending = 0
    if waiting:
        yield from work()
    if head is not None and part >= 0:
        ends: dict[tuple[int, int], tuple] = {}
        for doc, tree, label, sketch in zip(*(head[c].to_pylist() for c in ("doc_id", "tree", "label", "sketch"))):
            ends[(tree, doc)] = (doc, tree, label, sketch)
        for doc, tree, label, sketch in zip(ids.tolist(), orders.tolist(), labels, sketches):
            ends[(tree, doc)] = (doc, tree, label.tobytes(), sketch.tobytes())
        doc, tree, label, sketch = zip(*ends.values())
        yield rows(1, list(doc), list(tree), list(label), list(sketch), [None] * len(doc), [None] * len(doc))


FOREST = "kind int, doc_id long, tree int, label binary, sketch binary, b long, score float"


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) with the share of equal sketch bytes; ``doc_id`` of the crowded rows.

    Rows at the ends of the range partitions go through the same step again, in ever fewer partitions,
    so that no neighbourhood is cut.
    """
    spark = signed.sparkSession
    level = signed.select("doc_id", F.posexplode("labels").alias("tree", "label"), "sketch")
    parts, pairs, crowd = max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), None, None
    while True:
        order = ["tree", "label", "doc_id"]
        found = stored((level.repartitionByRange(parts, *order) if parts > 1 else level.coalesce(1))
                       .sortWithinPartitions(*order).mapInArrow(_forest, FOREST), "forest")
        own = found.where("kind = 0").select(F.col("doc_id").alias("a"), "b", "score")
        pairs = own if pairs is None else pairs.unionAll(own)
        full = found.where("kind = 2").select("doc_id")
        crowd = full if crowd is None else crowd.unionAll(full)
        if parts == 1:
            break
        level = found.where("kind = 1").select("doc_id", "tree", "label", "sketch")
        parts //= 64
        parts = max(1, parts)
    return (stored(pairs.groupBy("a", "b").agg(F.max("score").alias("score")), "candidates"),
            stored(crowd.distinct(), "crowd"))


def _sets(batches: Iterator[pa.RecordBatch], words: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_groups(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()),
             pa.array([x.tobytes() for x in shingle_sets(texts, words)], pa.binary())], names=["doc_id", "shingles"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least ``percent`` of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _stream(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        size = 0
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            tested = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "shingles", "edges"))
            for doc, raw, edges in zip(*columns):
                own = np.frombuffer(raw, np.uint64)
                for edge in sorted(edges, key=lambda e: -e["score"]):
                    other = edge["p"]
                    if other in held and root(doc) != root(other):
                        good = linked(own, held[other], percent)
                        tested.append((min(doc, other), max(doc, other), good))
                        if good:
                            parent[root(doc)] = root(other)
                held[doc] = own
                size += own.nbytes
                while size > WINDOW_BYTES and len(held) > 1:
                    size -= held.popitem(last=False)[1].nbytes
            a, b, good = zip(*tested) if tested else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())],
                names=["a", "b", "linked"])
    return run


def _pairwise(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())],
                                             names=["a", "b", "linked"])
    return run


def _tied_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars around the smallest document: the same components from fewer rounds."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    rows = [(root(x), x) for x in parent if root(x) != x]
    for start in range(0, len(rows), 65_536):
        a, b = zip(*rows[start:start + 65_536])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def tied_documents(links: DataFrame) -> DataFrame:
    return components(links.select("a", "b").mapInArrow(_tied_within, "a long, b long"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of this task have a shingle of each of COUNTERS hash values."""
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        every = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
        counts += np.bincount((every % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _rarest(percent: int, counts: np.ndarray):
    """Rows of the rarest shingles of each set: those that one of any two sets at the threshold must share.

    Sets of ``n`` and at most ``n`` shingles at the threshold share ``percent`` of ``n``, and at least
    2 ``percent`` / (100 + ``percent``) of the smaller. In one order of all shingles, a set less that overlap
    and one more is a prefix that meets the other's. ``small`` marks the prefix as the smaller set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, sizes, small = [], [], []
            for raw in batch.column("shingles").to_pylist():
                own = np.frombuffer(raw, np.uint64)
                n = len(own)
                own = own[np.lexsort((own, counts[(own % np.uint64(COUNTERS)).astype(np.int64)]))]
                first.append(own[:n + 1 - -(-percent * n // 100)].view(np.int64))
                sizes.append(n)
                small.append(np.arange(len(first[-1])) < n + 1 - -(-2 * percent * n // (100 + percent)))
            if not sizes:
                continue
            lengths = [len(x) for x in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(first)), *(pa.array(np.repeat(batch.column(x).to_numpy(), lengths))
                                                    for x in ("doc_id", "c")), pa.array(np.repeat(sizes, lengths)),
                 pa.array(np.concatenate([np.arange(x) for x in lengths])), pa.array(np.concatenate(small))],
                names=["shingle", "doc_id", "c", "n", "place", "small"])
    return run


def crowded_pairs(crowd: DataFrame, sets: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """All pairs of crowded documents of different components that can reach ``percent``, by their rarest shingles."""
    own = crowd.join(tied.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    own = stored(sets.join(own.select("doc_id", F.coalesce("c", "doc_id").alias("c")), "doc_id")
                 .select("doc_id", "c", "shingles"), "crowded-sets")
    counts = np.zeros(COUNTERS, np.int64)
    found = own.mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    rows = stored(own.mapInArrow(_rarest(percent, counts), "shingle long, doc_id long, c long, n long, place long, "
                                                           "small boolean"), "rarest")
    # A shingle of one component has no pairs: a family that is tied goes no further.
    open_ = rows.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("small").alias("paired"))
    rows = stored(rows.join(open_.where("low != high and paired").select("shingle").hint("merge"), "shingle"), "open-rarest")
    x, y = rows.alias("x"), rows.where("small").alias("y")
    # What two sets share lies at their first common place or after it, for one of the rows of the pair.
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    met = x.join(y.hint("merge"), F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.c") != F.col("y.c")) & (F.struct("y.n", "y.doc_id") < F.struct("x.n", "x.doc_id"))
        & (100 * F.col("y.n") >= percent * F.col("x.n"))
        & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))))
    return stored(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
                  .groupBy("a", "b").agg(F.count("*").cast("float").alias("score")), "crowded-pairs")


def _closed(pairs: DataFrame, tied: DataFrame, tested: DataFrame, sets: DataFrame,
            percent: int) -> tuple[DataFrame, DataFrame]:
    """``tied`` and ``tested`` after all pairs between documents that are not tied yet were tested."""
    open_, whole = pairs, False
    while not whole:
        # Candidates between documents that are not tied yet: the best of each two components, then all; few at once.
        again = "ca" in open_.columns
        for end in ("a", "b"):
            names = tied.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            open_ = attached(open_.drop(f"c{end}"), names, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        open_ = attached(open_.where("ca != cb"), tested.select("a", "b"), ["a", "b"], "left_anti")
        open_ = stored(open_.select("a", "b", "score", "ca", "cb"), "open")
        n = open_.count()
        if not n:
            break
        whole = again or n <= PAIRS_AT_ONCE
        chosen = open_ if whole else stored(open_.groupBy(
            F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(
                F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b"), "best")
        checked = stored(
            attached(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), chosen.select("a", "b"), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
            .select("a", "b", "left", "right")
            .mapInArrow(_pairwise(percent), "a long, b long, linked boolean"), "checked")
        tested = tested.unionAll(checked)
        new = checked.where("linked").select("a", "b")
        if not new.isEmpty():
            # What is tied already goes on as stars.
            tied = tied_documents(tied.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(new))
    return tied, tested


def confirmed(pairs: DataFrame, crowd: DataFrame, docs: DataFrame, percent: int, words: int = SHINGLE) -> DataFrame:
    """Node and component after confirming candidate pairs, and the pairs of crowded documents, on full shingle sets."""
    nodes = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("doc_id"), F.col("b").alias("p"), "score"),
        F.struct(F.col("b").alias("doc_id"), F.col("a").alias("p"), "score"))).alias("x")).select("x.*")
    # Documents are ordered by the least of their neighbours' least neighbours: most groups are then in one place.
    near = stored(nodes.groupBy("doc_id").agg(F.collect_list(F.struct("p", "score")).alias("edges"), F.least(
        F.first("doc_id"), F.min("p")).alias("near")), "neighbours")
    place = (near.select(F.explode("edges.p").alias("doc_id"), "near").groupBy("doc_id")
             .agg(F.min("near").alias("place")))
    wanted = near.join(place.hint("merge"), "doc_id").select("doc_id", "edges", F.least("near", "place").alias("place"))
    needed = near.select("doc_id").unionAll(crowd).distinct()
    sets = stored(docs.join(needed.hint("merge"), "doc_id", "left_semi").mapInArrow(
        partial(_sets, words=words), "doc_id long, shingles binary"), "shingles")
    ordered = (wanted.join(sets.hint("merge"), "doc_id").repartitionByRange("place", "doc_id")
               .sortWithinPartitions("place", "doc_id").select("doc_id", "shingles", "edges"))
    tested = stored(ordered.mapInArrow(_stream(percent), "a long, b long, linked boolean"), "tested")
    tied, tested = _closed(pairs, tied_documents(tested.where("linked")), tested, sets, percent)
    if crowd.isEmpty():
        return tied
    return _closed(crowded_pairs(crowd, sets, tied, percent), tied, tested, sets, percent)[0]


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    percent: int = 80, words: int = SHINGLE) -> DataFrame:
    """Components of documents whose sets of runs of ``words`` words overlap by at least ``percent`` of their union.

    Returns per row: doc_id, n_shingles, component_id (smallest id reachable) and kept.

    Cases: a null or word-free text has an empty set and is its own component; a text of at most ``words``
    words is one shingle; equal texts, whatever their number, are one node; repeated rows share their
    component and are kept together; a row with a null id is linked with nothing (component null, kept);
    other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(source.mapInArrow(
        partial(_signed, words=words), "doc_id long, n_shingles long, print binary, sketch binary, labels array<binary>"), "signed")
    named = signed.where("doc_id is not null and print is not null")
    classes = stored(named.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    reps = (named.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
            .dropDuplicates(["doc_id"]))
    tied = confirmed(*candidates(reps), source.where("doc_id is not null"), percent, words)
    member = classes.join(tied.withColumnRenamed("node", "rep"), "rep", "left").select(
        "print", F.coalesce("component", "rep").alias("c"))
    return (signed.select("doc_id", "n_shingles", "print").join(member, "print", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
