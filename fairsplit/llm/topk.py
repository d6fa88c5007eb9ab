"""Exact top-k inner products by block-at-a-time pruning.

Vectors are numbers of whole steps; a dimension is a term, and a query weighs
it. Documents are ordered by a locality code and cut into ranges, the blocks.
A block's row holds its forward index (the matrix of its documents) and, for each
term, the smallest and the largest value; the sum over the terms of the larger
product with the query bounds every score in the block.

Queries are grouped by the same code into query blocks. First every query block
scores the document blocks with the highest bounds, which gives each query a
lower bound of its k-th score. Then a pair of a query block and a document block
is scored only if some query's bound in it reaches that query's k-th score, in
the order of the bounds, which stops once none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK, QUERY_BLOCK = 512, 128
#: Document blocks that a query block scores before any is pruned.
FIRST_BLOCKS = 4
#: Steps per unit, and document blocks whose bounds travel together.
SCALE, GROUP = 256, 256
_PLANES = np.random.default_rng(5).standard_normal((16, 4096))


def steps_of(vector: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component."""
    return np.floor(np.float64(scale) * vector.astype(np.float64))


def _coded(scale: int):
    """Valid vectors as whole steps, with a locality code: the signs against fixed planes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec, values in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if vec is None or values is None or any(x is None for x in values):
                    continue
                x = np.array(values, np.float64)
                if not np.isfinite(x).all():
                    continue
                x = steps_of(x, scale)
                if (np.abs(x) >= 2.0**53).any():
                    raise ValueError("a component is too large for exact whole steps")
                signs = _PLANES[:, :len(x)] @ x[:4096] > 0
                out.append((vec, int(np.packbits(signs)[:2].view(">u2")[0]), x.astype("<i8").tobytes()))
            ids, codes, rows = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(codes, pa.int32()), pa.array(rows, pa.binary())],
                names=["vec_id", "code", "steps"])
    return run


def matrix(rows: list[bytes]) -> np.ndarray:
    """Vectors as one matrix; shorter ones are filled with zeros."""
    width = max((len(r) for r in rows), default=0)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), "<i8").reshape(len(rows), width // 8)


def _narrow(m: np.ndarray) -> tuple[bytes, str]:
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8")
                if not m.size or (m.min() >= np.iinfo(k).min and m.max() <= np.iinfo(k).max))
    return m.astype(kind).tobytes(), kind


BLOCKED = "block long, ids binary, steps binary, kind string, width int, low binary, high binary"


def _blocks(size: int):
    """Sorted rows as blocks of ``size``; numbers are unique over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        rows: list[bytes] = []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal number, ids, rows
            m = matrix(rows[:n])
            steps, kind = _narrow(m)
            out = (number, np.array(ids[:n], "<i8").tobytes(), steps, kind, m.shape[1],
                   m.min(axis=0).astype("<i8").tobytes(), m.max(axis=0).astype("<i8").tobytes())
            number, ids, rows = number + 1, ids[n:], rows[n:]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(),
                                                        pa.binary(), pa.binary()))],
                names=[f.split()[0] for f in BLOCKED.split(", ")])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            rows += batch.column("steps").to_pylist()
            while len(rows) >= size:
                yield cut(size)
        if rows:
            yield cut(len(rows))
    return run


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest possible score of each query (rows) in each block (columns); exact sums or rounded up."""
    width = max(queries.shape[1], low.shape[1])
    q, low, high = _wide(queries, width), _wide(low, width), _wide(high, width)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    total = up @ high.T.astype(np.float64) + down @ low.T.astype(np.float64)
    reach = up @ np.abs(high.T).astype(np.float64) - down @ np.abs(low.T).astype(np.float64)
    return np.where(reach < 2.0**52, total, total + reach * 1e-12)


def scores(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    width = max(queries.shape[1], docs.shape[1])
    q, d = _wide(queries, width), _wide(docs, width)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, width)
    if most < 2.0**53:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return q @ d.T
    return q.astype(object) @ d.T.astype(object)


def _row(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[prefix + "ids"], "<i8")
    return ids, np.frombuffer(row[prefix + "steps"], row[prefix + "kind"]).reshape(len(ids), -1).astype(np.int64)


HITS = "query_id long, vec_id long, score long"


def _score(k: int):
    """The k best of each query in one document block, those below the query's k-th score left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                queries, q = _row(row, "q_")
                docs, d = _row(row, "d_")
                got = scores(q, d)
                floor = np.frombuffer(row["floor"], "<i8") if row["floor"] is not None else None
                for i, query in enumerate(queries.tolist()):
                    own = got[i]
                    keep = np.flatnonzero((docs != query) & ((own >= floor[i]) if floor is not None else True))
                    if len(keep) > k:
                        keep = keep[np.lexsort((docs[keep], -own[keep]))[:k]]
                    out += [(query, int(docs[j]), int(own[j])) for j in keep]
            query, vec, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()),
                                              pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])
    return run


CHOSEN = "q_block long, d_block long, floor binary"


def _choose(first: int | None):
    """Pairs to score of each query block and group of document blocks, in the order of the bounds.

    With ``first``, the best blocks by the sum of bounds; else those that some query's k-th score admits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, q = _row(row, "q_")
                low, high = matrix(row["lows"]), matrix(row["highs"])
                bound = bounds(q, low, high)
                if first is not None:
                    best = np.argsort(-bound.sum(axis=0), kind="stable")[:first]
                else:
                    floor = np.frombuffer(row["floor"], "<i8")
                    best = np.argsort(-bound.max(axis=0), kind="stable")
                    best = best[(bound >= floor[:, None]).any(axis=0)[best]]
                out += [(row["q_block"], row["blocks"][b], row["floor"]) for b in best]
            q, d, floor = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()),
                                              pa.array(floor, pa.binary())], names=["q_block", "d_block", "floor"])
    return run


def _scored(chosen: DataFrame, query_blocks: DataFrame, doc_blocks: DataFrame, k: int) -> DataFrame:
    q = query_blocks.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "steps", "kind")))
    d = doc_blocks.select(*(F.col(c).alias(f"d_{c}") for c in ("block", "ids", "steps", "kind")))
    pairs = chosen.join(d, "d_block").join(q, "q_block").drop("q_block", "d_block")
    return pairs.mapInArrow(_score(k), HITS)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their ranks; ties go to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """The k highest inner products of each vector whose id is divisible by ``every``, over all other vectors.

    Returns query_id, rank (from 1), vec_id and score; fewer rows where there are fewer candidates.

    Cases: a vector that is null, or has a null or non-finite component, takes no part, nor does a null
    id; vectors of different lengths meet on their common dimensions; an empty vector scores 0; rows that share
    an id are one vector (the smallest in byte order); other columns are ignored; a component of 2^53 steps or
    more is an error; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    coded = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(
        _coded(scale), "vec_id long, code int, steps binary").groupBy("vec_id").agg(
        F.min(F.struct("steps", "code")).alias("x")).select("vec_id", "x.code", "x.steps")
    coded = stored(coded, "vectors")
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)

    def cut(rows: DataFrame, size: int, name: str) -> DataFrame:
        return stored(rows.repartitionByRange(parts, "code", "vec_id").sortWithinPartitions("code", "vec_id")
                      .mapInArrow(_blocks(size), BLOCKED), name)

    doc_blocks = cut(coded, BLOCK, "doc-blocks")
    query_blocks = cut(coded.where(F.col("vec_id") % every == 0), QUERY_BLOCK, "query-blocks")
    # Bounds travel in groups of blocks, one row each; a query block meets every group once.
    number = max(1, doc_blocks.count() // GROUP)
    groups = stored(doc_blocks.select("block", "low", "high", F.pmod(F.xxhash64("block"), F.lit(number))
                                      .cast("int").alias("group")).groupBy("group").agg(
        F.collect_list(F.struct("block", "low", "high")).alias("x")).select(
        "group", F.col("x.block").alias("blocks"), F.col("x.low").alias("lows"), F.col("x.high").alias("highs")),
        "bound-groups")
    spread = query_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                                 F.col("steps").alias("q_steps"), F.col("kind").alias("q_kind"),
                                 F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("group"))
    met = spread.join(groups, "group")
    first = met.withColumn("floor", F.lit(None).cast("binary")).mapInArrow(_choose(FIRST_BLOCKS), CHOSEN)
    seeds = stored(best(_scored(first, query_blocks, doc_blocks, k), k).drop("rank"), "seeds")
    kth = seeds.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select(
        "query_id", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(-(1 << 63))).alias("s"))
    floors = _floors(query_blocks, kth)
    rest = met.join(floors, "q_block").mapInArrow(_choose(None), CHOSEN)
    hits = _scored(rest, query_blocks, doc_blocks, k).unionAll(seeds).distinct()
    return best(hits, k).select("query_id", "rank", "vec_id", "score")


def _floors(query_blocks: DataFrame, kth: DataFrame) -> DataFrame:
    """The k-th scores of each query block's queries, in their order; the lowest number where there are none."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b, i, q) for b, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist())
                   for i, q in enumerate(np.frombuffer(ids, "<i8").tolist())]
            b, i, q = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(i, pa.int32()), pa.array(q, pa.int64())],
                                             names=["q_block", "place", "query_id"])

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["place"].to_pylist(), table["s"].to_pylist()))
        return pa.table({"q_block": table["q_block"].slice(0, 1),
                         "floor": pa.array([np.array([s for _, s in rows], "<i8").tobytes()], pa.binary())})

    members = query_blocks.select("block", "ids").mapInArrow(unpack, "q_block long, place int, query_id long")
    return (members.join(kth, "query_id", "left").withColumn("s", F.coalesce("s", F.lit(-(1 << 63))))
            .groupBy("q_block").applyInArrow(fold, "q_block long, floor binary"))


def oracle_sql(k: int = 5, every: int = 50, scale: int = SCALE) -> str:
    """The registered query for DuckDB, by scoring every pair."""
    return f"""
WITH v AS (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.x::DOUBLE[], d.x::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id != d.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""
