"""Penalised logistic regression by Newton steps over aggregates.

A pass over the rows adds up, in numpy within the tasks and then in Spark, the sums
that a Newton step needs: X'WX, X'(p - y) and the loss, a few numbers per feature and task.
The optimum is that of the summed log loss plus half the squared weights of the
standardised features, with a free intercept; the input takes one form at every size.

With ``by``, one model per group is fitted in the same passes. Its state is a row of a
stored table, and the step is taken where that row lies.

A categorical covariate of any width is a block: its dummies never share a row, so their
part of X'WX is a diagonal, kept as one row per level of a table. A step first removes the
block from the system (its Schur complement is a sum over levels), solves for the few dense
weights at the driver, and gets the levels' steps as a column. Several such covariates take
turns. No level ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StatisticsError
from ..functions.columns import quoted
from ..plans.attach import attach, join_levels
from ..plans.storage import discard, materialize

#: A search ends when the next step would lower the loss by less than this share.
TOLERANCE = 1e-15
MAX_PASSES = 200
#: Groups whose sums a task holds before it hands them on.
GROUPS_HELD = 2_000
#: Tables of levels up to this counted size are sent to every task; larger ones are joined by shuffle.
BROADCAST_LEVELS = 500_000


@dataclass
class Search:
    """Weights that a pass judges: ``base`` plus ``t`` steps. ``loss`` is that of ``base``."""

    base: np.ndarray
    step: np.ndarray
    t: float = 1.0
    loss: float = float("inf")
    done: bool = False

    @property
    def at(self) -> np.ndarray:
        return self.base + self.t * self.step

    def worse(self, loss: float) -> bool:
        return loss > self.loss + 1e-12 * abs(self.loss) and self.t > 1e-6

    def advanced(self, hessian: np.ndarray, gradient: np.ndarray, loss: float) -> Search:
        """The next search from the sums at ``at``; a step that made it worse is halved."""
        if self.worse(loss):
            return replace(self, t=self.t / 2)
        step = -solved(hessian, gradient)
        return Search(self.at, step, 1.0, loss, bool(-gradient @ step <= TOLERANCE * max(1.0, loss)))

    def packed(self) -> list[float]:
        return [float(self.done), self.t, self.loss, *self.base.tolist(), *self.step.tolist()]

    @classmethod
    def unpacked(cls, x: np.ndarray) -> Search:
        base, step = np.split(np.asarray(x[3:], float), 2)
        return cls(base, step, float(x[1]), float(x[2]), bool(x[0]))


def solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]


@dataclass
class Block:
    """A categorical covariate as a table of its levels: ``k`` (a whole number from 1; 0 and null are the base level, which has no
    weight), ``n`` rows, of ``total``; ``largest`` is the most rows of a level and ``size`` the number of levels."""

    column: str
    levels: DataFrame
    size: int
    total: int
    largest: int


@dataclass
class Fit:
    """Intercept and weights of the standardised dense features; a table ``k``, ``beta`` per block (not standardised)."""

    intercept: float
    weights: list[float]
    passes: int
    blocks: list[DataFrame] = field(default_factory=list)


def _cells(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of sums (one per dense weight: its row of X'WX, its slope, and the loss in the first); w and the residuals."""
    p = 1 / (1 + np.exp(-z))
    w, r = p * (1 - p), p - y
    out = np.zeros((x.shape[1], x.shape[1] + 2))
    out[:, :-2] = (x * w[:, None]).T @ x
    out[:, -2] = r @ x
    out[0, -1] = np.sum(np.logaddexp(0, z) - y * z)
    return out, w, r


def _totals(width: int, theta: np.ndarray | None, with_levels: bool):
    """Sums of a task: ``g`` (group), ``i`` (dense weight, or -1), ``k`` (level), and columns c0, c1, ..."""
    names = [f"c{i}" for i in range(width + 2)]

    def table(g, i, k, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(g, pa.int64()), pa.array(i, pa.int32()), pa.array(k, pa.int64()),
             *(pa.array(cells[:, j]) for j in range(width + 2))], names=["g", "i", "k", *names])

    def held_rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        groups = np.repeat(np.array(list(held), np.int64), width)
        rows = np.tile(np.arange(width), len(held))
        return table(groups, rows, np.zeros(len(groups), np.int64), np.concatenate(list(held.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, width))
            for j in range(1, width):
                x[:, j] = batch.column(f"x{j}").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            if theta is not None:
                z = x @ theta
                if with_levels:
                    z += batch.column("o").to_numpy(zero_copy_only=False)
                cells, w, r = _cells(x, y, z)
                held[0] = held[0] + cells if 0 in held else cells
                if with_levels:
                    k, at = np.unique(batch.column("k").to_numpy(zero_copy_only=False), return_inverse=True)
                    sums = np.zeros((len(k), width + 2))
                    for j in range(width):
                        sums[:, j] = np.bincount(at, w * x[:, j], len(k))
                    sums[:, width] = np.bincount(at, r, len(k))
                    yield table(np.zeros(len(k)), np.full(len(k), -1), k, sums)
                continue
            group = batch.column("g").to_numpy(zero_copy_only=False)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
            for rows in np.split(order, starts[1:]):
                g = int(group[rows[0]])
                own = np.asarray(batch.column("theta")[int(rows[0])].as_py(), float)
                cells, _, _ = _cells(x[rows], y[rows], x[rows] @ own)
                held[g] = held[g] + cells if g in held else cells
            if len(held) >= GROUPS_HELD:
                yield held_rows(held)
                held = {}
        if held:
            yield held_rows(held)

    shape = "g long, i int, k long, " + ", ".join(f"{n} double" for n in names)
    return run, shape, names


def _matrix(rows: list, names: Sequence[str]) -> np.ndarray:
    return np.array([[r[n] for n in names] for r in sorted(rows, key=lambda r: r["i"])], float)


def _ridge(width: int) -> np.ndarray:
    """Every standardised weight is penalised, the intercept is not."""
    return np.append(0.0, np.ones(width - 1))


def fit(rows: DataFrame, treated: str, features: Sequence[Column], blocks: Sequence[Block] = ()) -> Fit:
    """One model over all rows; ``features`` are standardised columns."""
    width = len(features) + 1
    narrow = rows.select(F.col(treated).cast("double").alias("y"),
                         *[f.cast("double").alias(f"x{j}") for j, f in enumerate(features, 1)],
                         *[F.coalesce(F.col(quoted(b.column)), F.lit(0)).cast("long").alias(f"k{i}")
                           for i, b in enumerate(blocks)])
    if blocks:
        return _fit_blocks(narrow, width, blocks)
    search = Search(np.zeros(width), np.zeros(width))
    for turn in range(1, MAX_PASSES + 1):
        run, shape, names = _totals(width, search.at, False)
        summed = narrow.mapInArrow(run, shape).groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect()
        if not summed:
            raise StatisticsError("A model needs rows.")
        search = _stepped(search, _matrix(summed, names))
        if search.done:
            return Fit(float(search.at[0]), search.at[1:].tolist(), turn)
    raise StatisticsError(f"The model has not settled within {MAX_PASSES} passes.")


def _stepped(search: Search, sums: np.ndarray) -> Search:
    ridge = _ridge(len(sums))
    return search.advanced(sums[:, :-2] + np.diag(ridge), sums[:, -2] + ridge * search.at,
                           sums[0, -1] + ridge @ search.at ** 2 / 2)


def with_level_weights(rows: DataFrame, blocks: Sequence[Block], tables: Sequence[DataFrame], name: str = "o") -> DataFrame:
    """The rows with ``name``, the sum of the weights of their levels; ``tables`` have ``k``, ``beta`` and ``n``."""
    columns, total = rows.columns, F.lit(0.0)
    for i, (block, table) in enumerate(zip(blocks, tables, strict=True)):
        weight = table.select(F.col("k").alias(block.column), F.col("beta").alias(f"_b{i}"), "n")
        if block.size <= BROADCAST_LEVELS:
            rows = rows.join(F.broadcast(weight.drop("n")), block.column, "left")
        else:
            # The base level gets a row, so that it can be joined like any other.
            base = weight.sparkSession.createDataFrame([(0, 0.0, block.total)], f"{block.column} long, _b{i} double, n long")
            rows = join_levels(rows, weight.unionByName(base), block.column, "n", block.total, block.total)
        total = total + F.coalesce(F.col(f"_b{i}"), F.lit(0.0))
    return rows.select(*[F.col(quoted(c)) for c in columns], total.alias(name))


def _schur(width: int):
    """Sums over the levels of a task: rows of B'B/D, B'g/D; in the first row the penalty and g'g/D."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width + 3))
        for batch in batches:
            get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
            b = np.stack([get(f"c{j}") for j in range(width)], axis=1)
            over, g = b / get("d")[:, None], get("g")
            out[:, :width] += over.T @ b
            out[:, width] += over.T @ g
            out[0, width + 1] += get("penalty").sum()
            out[0, width + 2] += (g * g / get("d")).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), *(pa.array(out[:, j]) for j in range(width + 3))],
            names=["i", *(f"c{j}" for j in range(width + 3))])
    return run, "i int, " + ", ".join(f"c{j} double" for j in range(width + 3))


def _fit_blocks(rows: DataFrame, width: int, blocks: Sequence[Block]) -> Fit:
    rows = materialize(rows, "fit_rows")
    blocks = [replace(b, column=f"k{i}") for i, b in enumerate(blocks)]
    tables = []
    for b in blocks:
        share = F.col("n") / F.lit(float(b.total))
        # The penalty of a standardised dummy's weight, said of the dummy itself.
        tables.append(materialize(b.levels.where("k > 0").select(
            "k", "n", (share * (1 - share)).alias("ridge"), F.lit(0.0).alias("beta"), F.lit(0.0).alias("step")), "levels"))
    search, last, quiet = Search(np.zeros(width), np.zeros(width)), 0, 0
    ridge, names = _ridge(width), [f"c{j}" for j in range(width + 3)]

    def on_trial(i: int) -> Column:
        """Weights of a block: those of the block that moved last go along its step."""
        return F.col("beta") + F.lit(search.t) * F.col("step") if i == last else F.col("beta")

    for turn in range(1, MAX_PASSES + 1):
        active = (last + 1) % len(blocks) if search.loss < float("inf") else last
        run, shape, cells = _totals(width, search.at, True)
        moved = [t.select("k", "n", "ridge", on_trial(i).alias("beta")) for i, t in enumerate(tables)]
        judged = with_level_weights(rows, blocks, moved).select(
            "y", *[f"x{j}" for j in range(1, width)], F.col(f"k{active}").alias("k"), "o")
        summed = judged.mapInArrow(run, shape).groupBy("i", "k").agg(*[F.sum(c).alias(c) for c in cells])
        # Sums of the dense weights (i) and of the levels (i = -1, with their weight) are one stored table.
        slope = F.col(f"c{width}") + F.col("ridge") * F.col("beta")
        now = materialize(summed.join(moved[active].withColumn("i", F.lit(-1)), ["i", "k"], "left")
                          .where("i >= 0 OR ridge IS NOT NULL").withColumns({
                              "d": F.col("c0") + F.col("ridge"), "g": slope,
                              "penalty": F.col("ridge") * F.col("beta") ** 2 / 2}), "fit_sums")
        run, shape = _schur(width)
        eliminated = now.where("i = -1").mapInArrow(run, shape).groupBy("i").agg(*[F.sum(n).alias(n) for n in names])
        dense = now.where("i >= 0").select("i", *cells, F.lit(0.0).alias(names[-1]))
        both = eliminated.withColumn("own", F.lit(False)).unionAll(dense.withColumn("own", F.lit(True))).collect()
        sums = _matrix([r for r in both if r["own"]], cells)
        part = _matrix([r for r in both if not r["own"]], names)
        others = sum(t.agg(F.sum(F.col("ridge") * F.col("beta") ** 2 / 2)).first()[0] or 0.0
                     for i, t in enumerate(moved) if i != active)
        loss = float(sums[0, -1] + ridge @ search.at ** 2 / 2 + part[0, width + 1] + others)
        if search.worse(loss):
            search = replace(search, t=search.t / 2)
            discard(now)
            continue
        gradient = sums[:, -2] + ridge * search.at
        right = part[:, width] - gradient
        step = solved(sums[:, :width] + np.diag(ridge) - part[:, :width], right)
        gain = float(right @ step + part[0, width + 2])
        along = F.lit(0.0)
        for j in range(width):
            along = along + F.lit(float(step[j])) * F.col(f"c{j}")
        old = tables[active]
        if last != active:
            tables[last] = moved[last].withColumn("step", F.lit(0.0))
        tables[active], last = now.where("i = -1").select(
            "k", "n", "ridge", "beta", (-(F.col("g") + along) / F.col("d")).alias("step")), active
        discard(old)
        search = Search(search.at, step, 1.0, loss)
        quiet = quiet + 1 if gain <= TOLERANCE * max(1.0, loss) else 0
        if quiet >= len(blocks):
            break
    else:
        raise StatisticsError(f"The model has not settled within {MAX_PASSES} passes.")
    discard(rows)
    return Fit(float(search.at[0]), search.at[1:].tolist(), turn,
               [t.select("k", "n", on_trial(i).alias("beta")) for i, t in enumerate(tables)])


def fit_groups(rows: DataFrame, treated: str, features: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """One model per group: ``(by..., n, intercept, weights, means, scales, passes)``.

    Features are standardised within their group (a constant one is only centred). A group with one arm only has null
    weights. ``by`` may hold nulls; rows with a missing feature are left out.
    """
    width = len(features) + 1
    names = [f"x{j}" for j in range(1, width)]
    narrow = rows.select(*[F.col(quoted(c)).alias(f"by{i}") for i, c in enumerate(by)],
                         F.col(treated).cast("double").alias("y"),
                         *[f.cast("double").alias(x) for x, f in zip(names, features, strict=True)]).na.drop(subset=["y", *names])
    keys = [f"by{i}" for i in range(len(by))]
    stats = narrow.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("t"),
        F.array(*[F.avg(x) for x in names]).alias("means"), F.array(*[F.var_pop(x) for x in names]).alias("variances"))
    eps = 2.220446049250313e-16
    n = F.col("n").cast("double")
    scale = F.zip_with("variances", "means", lambda v, m: F.when(
        v <= n * eps * v + F.pow(n * m * eps, F.lit(2)), 1.0).otherwise(F.sqrt(v)))
    start = Search(np.zeros(width), np.zeros(width)).packed()
    state = materialize(stats.withColumns({
        "scales": scale, "g": F.monotonically_increasing_id(), "passes": F.lit(0),
        "search": F.when((F.col("t") > 0) & (F.col("t") < F.col("n")), F.array(*[F.lit(x) for x in start]))})
        .drop("variances", "t"), "fit_groups")

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, cells in zip(batch.column("search").to_pylist(), batch.column("cells").to_pylist()):
                search = Search.unpacked(packed)
                out.append(_stepped(search, _matrix(cells, totals)).packed())
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), pa.array(out, pa.list_(pa.float64()))], names=["g", "next"])

    for _ in range(MAX_PASSES):
        live = state.where(F.col("search").isNotNull() & (F.col("search")[0] == 0.0))
        if live.isEmpty():
            break
        theta = F.zip_with(F.slice("search", 4, width), F.slice("search", 4 + width, width),
                           lambda b, s: b + s * F.col("search")[1])
        asked = live.select(*keys, "g", "means", "scales", theta.alias("theta"))
        scaled = attach(narrow, asked, keys).select("g", "y", "theta", *[
            ((F.col(x) - F.col("means")[j]) / F.col("scales")[j]).alias(x) for j, x in enumerate(names)])
        run, shape, totals = _totals(width, None, False)
        summed = scaled.mapInArrow(run, shape).groupBy("g", "i").agg(*[F.sum(c).alias(c) for c in totals])
        cells = summed.groupBy("g").agg(F.collect_list(F.struct("i", *totals)).alias("cells"))
        new = live.select("g", "search").join(cells, "g").mapInArrow(stepped, "g long, next array<double>")
        old = state
        state = materialize(old.join(new, "g", "left").withColumns({
            "search": F.coalesce("next", "search"),
            "passes": F.col("passes") + F.col("next").isNotNull().cast("int")}).drop("next"), "fit_groups")
        discard(old)
    found = F.zip_with(F.slice("search", 4, width), F.slice("search", 4 + width, width),
                       lambda b, s: b + s * F.col("search")[1])
    settled = F.when(F.col("search")[0] == 1.0, found)
    return state.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "n", settled[0].alias("intercept"),
                        F.slice(settled, 2, width - 1).alias("weights"), "means", "scales", "passes")
