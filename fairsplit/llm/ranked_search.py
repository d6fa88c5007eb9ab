"""Ranked lexical search for many queries at once, sharing what the queries have in common.

Every item is a query: a bag of terms. A document's score for an item is a sum of one
whole number per term, so sums can be shared. Pairs of addends that several items hold
are mined greedily, the most widely shared pair first; each becomes a node of a DAG
that adds two nodes, until every item is one node. A task turns its documents into one
accumulator per term, evaluates each node once for a block of documents, and reads the
items' scores off their nodes.

The documents are read twice: once as text, to leave the few terms that any item asks
for (a narrow table in the shared folder, from which the corpus counts are added up), and
once as that table, to be scored. A task hands on its best ``k`` documents of each item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_groups

TOP = 10
#: Distinct terms of the items that share one pass over the documents, and items that share one DAG.
BLOCK_TERMS, DAG_ITEMS = 500_000, 500
#: Bytes of the accumulators of a block of documents.
ACCUMULATOR_BYTES = 64_000_000
#: Parts that an item's candidates are ranked in before they meet.
SALTS = 32
#: A-Z to lower case, and every other ASCII sign that is no digit or letter to a gap.
_SIGNS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in order: runs of digits, letters and signs beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_SIGNS).split()


@dataclass
class Sharing:
    """A DAG of additions. Node i < len(leaves) is ``times`` the accumulator of ``leaves[i]``; the nodes after that
    add two earlier nodes, in ``steps`` of (nodes, left, right) that do not depend on each other; ``roots`` are the items'."""

    leaves: np.ndarray
    times: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    roots: np.ndarray
    size: int

    def evaluate(self, of_term: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from the accumulators of terms (terms x documents)."""
        nodes = np.empty((self.size, of_term.shape[1]), np.int64)
        np.multiply(of_term[self.leaves], self.times[:, None], out=nodes[:len(self.leaves)])
        for made, left, right in self.steps:
            nodes[made] = nodes[left] + nodes[right]
        return nodes[self.roots]


def share(items: list[dict[int, int]]) -> Sharing:
    """The DAG of items that are given as term numbers with their repeats; an item has one term at least."""
    number: dict[tuple[int, int], int] = {}
    parts = [{number.setdefault(x, len(number)) for x in sorted(item.items())} for item in items]
    leaves = list(number)
    holders: dict[int, set[int]] = defaultdict(set)
    together: Counter[tuple[int, int]] = Counter()
    for i, part in enumerate(parts):
        own = sorted(part)
        for j, a in enumerate(own):
            holders[a].add(i)
            together.update((a, b) for b in own[j + 1:])
    made: list[tuple[int, int]] = []
    heap = [(-n, pair) for pair, n in together.items() if n > 1]
    heapify(heap)
    while heap:
        n, (a, b) = heappop(heap)
        both = holders[a] & holders[b]
        if len(both) < 2:
            continue
        if len(both) < -n:
            heappush(heap, (-len(both), (a, b)))
            continue
        new = len(leaves) + len(made)
        made.append((a, b))
        beside: Counter[int] = Counter()
        for i in both:
            parts[i] -= {a, b}
            beside.update(parts[i])
            parts[i].add(new)
        holders[a] -= both
        holders[b] -= both
        holders[new] = both
        for other, n in beside.items():
            if n > 1:
                heappush(heap, (-n, (other, new)))
    roots = []
    for part in parts:  # what is left is one item's own
        left = sorted(part)
        while len(left) > 1:
            pairs = list(zip(left[::2], left[1::2]))
            rest = left[2 * len(pairs):]
            left = list(range(len(leaves) + len(made), len(leaves) + len(made) + len(pairs))) + rest
            made += pairs
        roots.append(left[0])
    depth = [0] * len(leaves)
    steps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for new, (a, b) in enumerate(made, len(leaves)):
        depth.append(1 + max(depth[a], depth[b]))
        steps[depth[-1]].append((new, a, b))
    columns = [tuple(np.array(x) for x in zip(*steps[d])) for d in sorted(steps)]
    return Sharing(np.array([t for t, _ in leaves], np.int64), np.array([n for _, n in leaves], np.int64), columns,
                   np.array(roots, np.int64), len(leaves) + len(made))


def _occurrences(number: dict[bytes, int]):
    """Of a document: how many terms it has, and which numbered terms occur how often (two 32-bit numbers each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_groups(batches, "text"):
            n, hits = [], []
            for text in texts:
                own = terms(text)
                n.append(len(own))
                held = [(number[t], m) for t, m in Counter(own).items() if t in number]
                hits.append(np.array(held, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.binary())],
                names=["doc_id", "n", "hits"])
    return run


def _document_counts(size: int):
    """In how many documents of a task each term occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            joined = np.frombuffer(b"".join(batch.column("hits").to_pylist()), "<i4")
            seen += np.bincount(joined[::2], minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["term", "df"])
    return run


def weight(df: int, documents: int) -> int:
    """Whole-number weight of a term."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best ``k`` documents of each item so far: highest score first, then the smaller id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.zeros(items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the items from number ``first`` on."""
        floor = np.maximum(self.floor[first:first + len(scores)], 1)
        item, at = np.nonzero(scores >= floor[:, None])
        if not len(item):
            return
        item_all = np.concatenate([self.item, item + first])
        doc, score = np.concatenate([self.doc, ids[at]]), np.concatenate([self.score, scores[item, at]])
        order = np.lexsort((doc, -score, item_all))
        item_all = item_all[order]
        starts = np.flatnonzero(np.append(True, item_all[1:] != item_all[:-1]))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order, item_all = order[place < self.k], item_all[place < self.k]
        self.item, self.doc, self.score = item_all, doc[order], score[order]
        full = np.bincount(item_all, minlength=len(self.floor)) >= self.k
        last = np.append(item_all[1:] != item_all[:-1], True)
        last &= full[item_all]
        self.floor[item_all[last]] = self.score[last]


def _scored(dags: list[Sharing], weights: np.ndarray, documents: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sum(len(d.roots) for d in dags), k)
        # Terms of an accumulator: those that occur in the block of documents, or at most all.
        block = max(1, ACCUMULATOR_BYTES // (8 * (len(weights) + max(d.size for d in dags))))
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                hits = part.column("hits").to_pylist()
                n = np.asarray(part.column("n"))
                doc = np.repeat(np.arange(len(hits)), [len(x) // 8 for x in hits])
                term, tf = np.frombuffer(b"".join(hits), "<i4").reshape(-1, 2).astype(np.int64).T
                size = 25 + (75 * n * documents) // length
                of_term = np.zeros((len(weights), len(hits)), np.int64)
                of_term[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * size[doc]))
                ids, first = np.asarray(part.column("doc_id")), 0
                for dag in dags:
                    best.add(first, dag.evaluate(of_term), ids)
                    first += len(dag.roots)
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc), pa.array(best.score)],
                                         names=["item", "doc_id", "score"])
    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list, dict[bytes, int], list[dict[int, int]]]]:
    """Item ids, numbers of terms, and items as numbered terms, in blocks of about ``limit`` distinct terms."""
    ids, number, bags = [], {}, []
    for row in items.toLocalIterator():
        bag = Counter(t for text in row["texts"] for t in terms(text.encode()))
        if not bag:
            continue
        if ids and len(number) + len(bag) > limit:
            yield ids, number, bags
            ids, number, bags = [], {}, []
        ids.append(row["item_id"])
        bags.append({number.setdefault(t, len(number)): n for t, n in bag.items()})
    if ids:
        yield ids, number, bags


def _searched(source: DataFrame, ids: list, number: dict[bytes, int], bags: list[dict[int, int]], k: int,
              kind: str) -> DataFrame:
    spark = source.sparkSession
    held = stored(source.mapInArrow(_occurrences(number), "doc_id long, n long, hits binary"), "item-terms")
    total = held.agg(F.sum((F.col("n") > 0).cast("long")).alias("documents"), F.sum("n").alias("length")).first()
    shape = f"item_id {kind}, doc_id long, score long"
    if not total["length"]:
        return spark.createDataFrame([], shape)
    asked = held.where(F.length("hits") > 0)
    counts = dict(asked.select("hits").mapInArrow(_document_counts(len(number)), "term int, df long")
                  .groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator())
    weights = np.array([weight(counts.get(t, 0), total["documents"]) for t in range(len(number))], np.int64)
    dags = [share(bags[i:i + DAG_ITEMS]) for i in range(0, len(bags), DAG_ITEMS)]
    found = asked.where(F.col("doc_id").isNotNull()).mapInArrow(
        _scored(dags, weights, total["documents"], total["length"], k), "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest score above 0 of each item: item_id, rank (from 1), doc_id, score.

    Equal scores are ranked by document id. Document ids are whole numbers. Items are handled in blocks of
    about BLOCK_TERMS distinct terms; a block is one pass over the documents, and its terms and DAG are all that
    the driver holds.

    Cases: a text without terms, empty or null, is no document and finds nothing; rows that share an item id are one
    item with the terms of all of them, in any order; rows with a null item id are left out; a document with a null id counts but is not ranked;
    repeated document rows count, and are ranked, each; a text of any length is one row of counts; extra columns are
    ignored; with an empty table on either side there are no rows.
    """
    kind = items.schema[item_column].dataType.simpleString()
    queries = (items.where(F.col(item_column).isNotNull() & F.col(item_text).isNotNull())
               .groupBy(F.col(item_column).alias("item_id")).agg(F.collect_list(item_text).alias("texts"))
               .orderBy("item_id"))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = [_searched(source, *block, k, kind) for block in _blocks(queries, BLOCK_TERMS)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = reduce(DataFrame.unionAll, parts)
    best = [F.desc("score"), F.asc("doc_id")]
    salted = Window.partitionBy("item_id", F.pmod("doc_id", F.lit(SALTS))).orderBy(*best)
    whole = Window.partitionBy("item_id").orderBy(*best)
    few = found.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k)
    return (few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def oracle_sql() -> str:
    """The registered query's rows in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH words AS (SELECT doc_id, unnest({found}) AS term FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times
          FROM (SELECT item_id, unnest({found}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM counted WHERE term IN (SELECT term FROM asked) GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM held, total),
scored AS (
  SELECT item_id, c.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * docs) // len)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted c USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, c.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= {TOP}"""
