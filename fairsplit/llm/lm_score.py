"""Document scores of a hashed maximum-entropy language model, beside an add-one unigram base.

Every word of the learning documents has a path in a tree: its class, its place in the class (a symbol), and as many
steps of sixteen below the symbol as its count calls for, so that frequent words have short paths. The sixteenth of the
words that occur most have a path each; the others are dealt by their hash to groups, one for about sixteen words, that
have a path each, and within its group a word has the probability of its smoothed count. The numbers of both grow with
the words counted. Each step of a path is a softmax over weights of hashed features of the words before: the last word,
the last two, and the second and third last on their own (skips). Of the words before, the class and the symbol are
told their symbols, the steps below the words themselves. The weights
are trained on every learning document: each task makes mini-batch gradient steps
over its part, and what they have become is averaged in steps of a tree. Scoring runs in
numpy batches inside the tasks.

Word counts cover the whole corpus. Each task sends, for groups of documents,
the distinct word hashes of each document, packed by hash bucket; a bucket counts
its words over all learning documents and answers with sums per document; the
answers meet again by document group. No word list is held anywhere as a whole, but for that sixteenth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard
from .common import GROUP_BYTES, remainder, stored, text_groups
from .near_dedup import word_hashes

CLASSES = MEMBERS = 16
SYMBOLS = CLASSES * MEMBERS
#: The mark before a text's first word.
START = SYMBOLS
#: Rows of the hashed weight table of classes and members.
ROWS = 1 << 12
#: Children of each step below a symbol, as a power of two.
STEP = 4
#: One in so many words has a path of its own; one group for so many words.
SPREAD = 16
#: Words and groups of which a smaller corpus has as many.
LEAST_WORDS, LEAST_GROUPS = 4096, 256
#: Rows of the hashed weight table of the steps below the symbols.
STEP_ROWS = 1 << 18
#: A learning task has so many tokens at least, unless there are no more tasks than cores.
TASK_TOKENS = 3_000_000
#: Weights of a slice, and tasks that add up the slices of the learning tasks.
SLICE, MERGES = 1 << 14, 64
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 1_000_000
BATCH, RATE = 2048, 0.25
#: Tokens whose paths are held at once, one text at least.
PATH_TOKENS = 1 << 17
#: Exponents up to this size are taken as they are.
LOGIT = 40
#: Tokens of one weight row that are added up side by side with those of other rows.
SHORT_RUN = 6
END = np.uint64(0x517CC1B727220A95)


@dataclass
class Tree:
    """Places of ranked items: symbols of depth 0 hold one item, of depth 1 sixteen, of depth 2 sixteen times that, ...

    By depth: the first rank, the first symbol and the first node below it; the node numbers by depth and step.
    """

    ranks: np.ndarray
    symbols: np.ndarray
    nodes: np.ndarray

    def depth(self, rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ranks[1:-1], rank, side="right")

    def symbol(self, rank: np.ndarray) -> np.ndarray:
        depth = self.depth(rank)
        return self.symbols[depth] + ((rank - self.ranks[depth]) >> STEP * depth)

    def steps(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each item's steps begin (one more entry at the end), and the node and the child of each step."""
        depth = self.depth(rank)
        begins = np.concatenate(([0], np.cumsum(depth)))
        nodes, children = np.empty((2, begins[-1]), np.int32)
        for deep in range(1, len(self.symbols)):
            items = np.flatnonzero(depth == deep)
            at, place = begins[items], (rank[items] - self.ranks[deep]).astype(np.int32)
            for number in range(deep):
                up = place >> STEP * (deep - number - 1)
                nodes[at + number] = self.nodes[deep, number] + (up >> STEP)
                children[at + number] = up & ((1 << STEP) - 1)
        return begins, nodes, children


def log_shares(weight: np.ndarray) -> np.ndarray:
    """Logarithms of each row's shares; what holds nothing has next to none."""
    return np.log(np.maximum(weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9), 1e-9))


def tree_of(counts: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree for items with these falling counts, and the logarithms of the shares of each node's children.

    An item's depth is the least at which it has a given share of its symbol; that share is the smallest for which the
    symbols suffice. The greatest depth is the one with the shortest paths on average.
    """
    weight = counts + 0.5
    below = np.concatenate(([0.0], np.cumsum(weight)))
    log_weight = -np.log(weight / below[-1])

    def sizes(limit: float, deepest: int) -> np.ndarray:
        out, begin = [], 0
        for depth in range(deepest + 1):
            end = np.searchsorted(log_weight, limit + depth * np.log(1 << STEP), side="right")
            end = len(counts) if depth == deepest else max(begin, int(end))
            out.append(-(-(end - begin) >> STEP * depth))
            begin = min(len(counts), begin + (out[-1] << STEP * depth))
        return np.array(out)

    best = None
    deepest = 0
    while best is None or deepest < len(best[1]) + 1:
        low, high = -1.0, float(log_weight.max(initial=0)) + 1
        if sizes(low, deepest).sum() <= SYMBOLS:
            for _ in range(40):
                middle = (low + high) / 2
                low, high = (middle, high) if sizes(middle, deepest).sum() <= SYMBOLS else (low, middle)
            k = sizes(low, deepest)
            ends = np.minimum(np.cumsum(k << STEP * np.arange(deepest + 1)), len(counts))
            steps = float((below[-1] - below[ends]).sum())
            if best is None or steps < best[0]:
                best = steps, k
        deepest += 1
    k = best[1]
    depths = np.arange(len(k))
    ranks = np.concatenate(([0], np.cumsum(k << STEP * depths)))
    nodes, base, first = np.zeros((len(k), len(k)), np.int64), [np.zeros((0, 1 << STEP))], 0
    for depth in depths[1:]:
        own = np.zeros(k[depth] << STEP * depth)
        part = weight[ranks[depth]:ranks[depth + 1]]
        own[:len(part)] = part
        for number in range(depth):
            nodes[depth, number] = first
            share = own.reshape(-1, 1 << STEP, 1 << STEP * (depth - number - 1)).sum(axis=2)
            base.append(log_shares(share))
            first += len(share)
    return (Tree(ranks, np.concatenate(([0], np.cumsum(k)[:-1])), nodes),
            np.concatenate(base).astype(np.float32))


@dataclass
class Model:
    """Sorted hashes and ranks of the words that have a path of their own, and the weights of classes and members.

    Below the symbols: the ranks of the groups of all other words, the tree, the shares of its nodes' children, and the
    weights of its steps.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    of_class: np.ndarray
    of_member: np.ndarray
    groups: np.ndarray | None = None
    tree: Tree | None = None
    base: np.ndarray | None = None
    of_step: np.ndarray | None = None

    def rank(self, words: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(words, return_inverse=True)
        own, at = listed(self.hashes, distinct)
        out = self.groups[group_of(distinct, len(self.groups))]
        out[own] = self.ranks[at[own]]
        return out[back]


def listed(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among sorted hashes, and where."""
    if not len(hashes):
        return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return hashes[at] == words, at


def group_of(words: np.ndarray, groups: int) -> np.ndarray:
    return ((words >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64)


def with_ends(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by the end token, and the number of tokens of each."""
    words, begins = word_hashes(texts)
    return np.insert(words, begins[1:], END), np.diff(begins) + 1


def _rows_of_symbols() -> list[np.ndarray]:
    """The rows of a feature by its symbols: one word, two words (the last one first), and two skips."""
    one = np.arange(START + 1, dtype=np.int64)
    pair = ((one[None, :] * 257 + one[:, None]) * 104_729 + 101).ravel()
    return [(1 + x % (ROWS - 1)).astype(np.int32)
            for x in (one * 7919 + 13, pair, one * 15_485_863 + 211, one * 32_452_843 + 307)]


_FEATURES = _rows_of_symbols()


def _before(tokens: np.ndarray, lengths: np.ndarray, start: int) -> list[np.ndarray]:
    """What stands one, two and three places before each token of its text, or ``start``."""
    first = np.cumsum(lengths) - lengths
    out = []
    for back in (1, 2, 3):
        shifted = np.full(len(tokens), start, tokens.dtype)
        shifted[back:] = tokens[:-back]
        for k in range(back):
            shifted[(first + k)[lengths > k]] = start
        out.append(shifted)
    return out


def context(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Weight rows of the features of each token: a constant, one word, two words, and two skips."""
    a, b, c = _before(symbols, lengths, START)
    out = np.zeros((len(symbols), 5), np.int32)
    for k, (table, at) in enumerate(zip(_FEATURES, (a, a * (START + 1) + b, b, c)), 1):
        out[:, k] = table[at]
    return out


def histories(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words before each token: one word, two words, and two skips."""
    a, b, c = _before((words >> np.uint64(32)).astype(np.uint32), lengths, START)
    return np.stack([a, b * np.uint32(0x85EBCA6B) + a, b * np.uint32(0xC2B2AE35) + np.uint32(211),
                     c * np.uint32(0x27D4EB2F) + np.uint32(307)], axis=1)


def step_rows(past: np.ndarray, nodes: np.ndarray, rows: int) -> np.ndarray:
    """Weight rows of steps at nodes after hashed histories; ``rows`` is a power of two."""
    mixed = (past ^ (nodes.astype(np.uint32) * np.uint32(0x9E3779B1))[:, None]) * np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x297A2D39)
    return (mixed >> np.uint32(33 - rows.bit_length())).astype(np.int32)


def _lowered(z: np.ndarray) -> np.ndarray:
    """Rows whose exponentials neither overflow nor vanish: as they are, or each less its maximum, in place."""
    if len(z) and not -LOGIT < z.min() <= z.max() < LOGIT:
        z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(_lowered(z))
    e /= np.einsum("ij->i", e)[:, None]
    return e


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one place."""
    z = _lowered(z)
    return z.ravel().take(_cells(z, at)) - np.log(np.einsum("ij->i", np.exp(z)))


def _cells(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of one column of each row in the whole table, row after row."""
    return np.arange(0, z.size, z.shape[1]) + at


def _slope(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Slopes of the negative logarithm of each row's softmax at one place."""
    p = _softmax(z)
    p.reshape(-1)[_cells(p, at)] -= 1
    return p


_VOID = {size: np.dtype((np.void, size)) for size in range(8, 513, 4)}


def _records(table: np.ndarray) -> np.ndarray:
    """The rows of a contiguous table as single values, which numpy copies faster than rows."""
    return table.view(_VOID[table.itemsize * table.shape[1]])[:, 0]


def _taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    width = table.shape[1]
    return table.view(_VOID[table.itemsize * width]).take(rows).view(table.dtype).reshape(-1, width)


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each token's rows of a table, one feature after the other."""
    out = _taken(table, rows[:, 0])
    for k in range(1, rows.shape[1]):
        out += _taken(table, rows[:, k])
    return out


def log_probabilities(model: Model, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithm of each symbol's probability after its context."""
    out = np.empty(len(symbols))
    members = model.of_member.reshape(-1, MEMBERS)
    for start in range(0, len(symbols), BATCH):
        s, r = symbols[start:start + BATCH], rows[start:start + BATCH]
        group, member = np.divmod(s, MEMBERS)
        out[start:start + BATCH] = (_log_softmax(_summed(model.of_class, r), group)
                                    + _log_softmax(_summed(members, r * CLASSES + group[:, None]), member))
    return out


def path_log_probabilities(model: Model, ranks: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each token's whole path; texts are handled some at a time."""
    out, ends, text = np.empty(len(words)), np.cumsum(lengths), 0
    while text < len(lengths):
        begin = ends[text] - lengths[text]
        stop = max(text + 1, int(np.searchsorted(ends, begin + PATH_TOKENS, side="right")))
        end = ends[stop - 1]
        out[begin:end] = _path_logs(model, ranks[begin:end], words[begin:end], lengths[text:stop])
        text = stop
    return out


def _path_logs(model: Model, ranks: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    symbols = model.tree.symbol(ranks)
    out = log_probabilities(model, symbols, context(symbols, lengths))
    begins, nodes, children = model.tree.steps(ranks)
    past = histories(words, lengths)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(begins))
    logs = np.empty(len(nodes))
    for start in range(0, len(nodes), BATCH):
        node, owners = nodes[start:start + BATCH], owner[start:start + BATCH]
        z = _summed(model.of_step, step_rows(_taken(past, owners), node, len(model.of_step)))
        z += _taken(model.base, node)
        logs[start:start + BATCH] = _log_softmax(z, children[start:start + BATCH])
    return out + np.bincount(owner, logs, len(words))


def _order(rows: np.ndarray, most: int) -> np.ndarray:
    """A stable order of row numbers below ``most``; numbers of two bytes are put in order by a radix sort."""
    return np.argsort(rows.astype(np.uint16 if most <= 1 << 16 else np.int64), kind="stable")


def _run_sums(slope: np.ndarray, source: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``slope`` at ``source`` added up over runs that begin at ``first``: short runs place by place, long ones each."""
    times = np.diff(np.append(first, len(source)))
    out = _taken(slope, source[first])
    open_runs = np.flatnonzero((times > 1) & (times <= SHORT_RUN))
    for k in range(1, SHORT_RUN):
        if not len(open_runs):
            break
        sums = _taken(out, open_runs)
        sums += _taken(slope, source[first[open_runs] + k])
        _records(out)[open_runs] = _records(sums)
        open_runs = open_runs[times[open_runs] > k + 1]
    long = np.flatnonzero(times > SHORT_RUN)
    if len(long):
        members = source[np.repeat(times > SHORT_RUN, times)]
        out[long] = np.add.reduceat(_taken(slope, members), np.cumsum(times[long]) - times[long], axis=0)
    return out


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray,
             order: np.ndarray | None = None) -> None:
    """One Adagrad step: ``slope`` of each token added up over the rows that its features touch."""
    flat = rows.ravel()
    order = _order(flat, len(table)) if order is None else order
    flat = flat[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    touched = flat[first]
    gradient = _run_sums(slope, order // rows.shape[1], first)
    total = _taken(seen, touched)
    total += gradient * gradient
    _records(seen)[touched] = _records(total)
    np.sqrt(total, out=total)
    total += 1
    gradient *= RATE
    gradient /= total
    weights = _taken(table, touched)
    weights -= gradient
    _records(table)[touched] = _records(weights)


def _descend_sparsely(table: np.ndarray, seen: np.ndarray, last: np.ndarray, rows: np.ndarray, weights: np.ndarray,
                      slope: np.ndarray) -> None:
    """The same for a table of which few rows are touched twice, from their weights, with one mean square sum a row.

    The last place of a row among all features has the row's sum; what earlier places write is written over by it.
    """
    flat = rows.ravel().astype(np.intp)
    place = np.arange(len(flat), dtype=np.int32)
    last[flat] = place
    own = last.take(flat)
    gradient = _records(slope).repeat(rows.shape[1]).view(slope.dtype).reshape(weights.shape)
    squares = np.repeat(np.einsum("ij,ij->i", slope, slope), rows.shape[1])
    early = np.flatnonzero(own != place)
    if len(early):
        early = early[np.argsort(own[early], kind="stable")]
        to = own[early]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        to = to[first]
        sums = _taken(gradient, to) + _run_sums(gradient, early, first)
        gradient[to], squares[to] = sums, np.einsum("ij,ij->i", sums, sums)
    total = seen.take(flat)
    total += squares / slope.shape[1]
    seen[flat] = total
    gradient *= (RATE / (1 + np.sqrt(total)))[:, None]
    weights -= gradient
    _records(table)[flat] = _records(weights)


def gradient_steps(model: Model, symbols: np.ndarray, rows: np.ndarray, seed: int,
                   steps: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, past: np.ndarray | None = None,
                   seen_step: np.ndarray | None = None) -> None:
    """Mini-batch steps over the tokens, in place; ``steps`` below the symbols, with the tokens' histories.

    ``seen_step`` is the sum of squares of each row of the steps so far.
    """
    seen_class = np.zeros_like(model.of_class)
    member_table = model.of_member.reshape(ROWS * CLASSES, MEMBERS)
    seen_member = np.zeros_like(member_table)
    last = None if steps is None else np.empty(len(model.of_step), np.int32)
    order = np.random.default_rng(seed).permutation(len(symbols))
    for start in range(0, len(order), BATCH):
        at = order[start:start + BATCH]
        s, r = symbols[at], _taken(rows, at)
        group, member = np.divmod(s, MEMBERS)
        cells = r * CLASSES + group[:, None]
        # Cells in order are rows in order.
        by_cell = _order(cells.ravel(), len(member_table))
        _descend(model.of_class, seen_class, r, _slope(_summed(model.of_class, r), group), by_cell)
        _descend(member_table, seen_member, cells, _slope(_summed(member_table, cells), member), by_cell)
        if steps is None:
            continue
        begins, nodes, children = steps
        depth = begins[at + 1] - begins[at]
        ends = np.cumsum(depth)
        if not ends[-1]:
            continue
        here = np.repeat(begins[at] - ends + depth, depth) + np.arange(ends[-1])
        node = nodes[here]
        cells = step_rows(_taken(past, np.repeat(at, depth)), node, len(model.of_step))
        weights = _taken(model.of_step, cells.ravel())
        z = _taken(model.base, node)
        for k in range(cells.shape[1]):
            z += weights[k::cells.shape[1]]
        _descend_sparsely(model.of_step, seen_step, last, cells, weights, _slope(z, children[here]))



def _added(words: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(words), return_inverse=True)
    return found, np.bincount(at, np.concatenate(n), len(found)).astype(np.int64)


def word_counts(learning: DataFrame) -> DataFrame:
    """Hash (as a signed number) and count of every word of all rows, stored."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

        words, times, waiting = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for _, texts in text_groups(batches, "text"):
            found, n = np.unique(with_ends(texts)[0], return_counts=True)
            words.append(found), times.append(n)
            waiting += len(found)
            # As many new entries as there are words already: each is sorted a few times only.
            if waiting > max(len(words[0]), COUNTED_WORDS // 8):
                together, n = _added(words, times)
                words, times, waiting = [together], [n], 0
            if len(words[0]) > COUNTED_WORDS:
                yield table(words[0], times[0])
                words, times = [words[0][:0]], [times[0][:0]]
        yield table(*_added(words, times))

    counted = learning.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted, "lm-words")


def _columns(df: DataFrame) -> list[np.ndarray]:
    return [column.to_numpy() for column in df.toArrow().columns]


def vocabulary(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words that have a path of their own, and the counts of the groups of all others.

    The words are those that occur at least so often; words that occur equally often are in or out together.
    """
    often, words = _columns(counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")))
    order = np.argsort(-often)
    often, words, total = often[order], words[order], int(words.sum())
    within = np.cumsum(words) <= max(LEAST_WORDS, total // SPREAD)
    least = int(often[within][-1]) if within.any() else np.iinfo(np.int64).max
    groups = max(LEAST_GROUPS, 1 << max(0, total // SPREAD - 1).bit_length())
    hashes, n = _columns(counted.where(F.col("n") >= least))
    order = np.argsort(hashes.view(np.uint64))
    group = F.shiftrightunsigned("word", 20).bitwiseAND(F.lit(groups - 1))
    place, together = _columns(counted.where(F.col("n") < least).groupBy(group.alias("g")).agg(F.sum("n").alias("n")))
    others = np.zeros(groups, np.int64)
    others[place] = together
    return hashes.view(np.uint64)[order], n[order], others


def start_model(hashes: np.ndarray, n: np.ndarray, others: np.ndarray) -> Model:
    """A model of the shares alone, from the counts of :func:`vocabulary`."""
    counts = np.concatenate([n, others])
    order = np.argsort(-counts, kind="stable")
    ranks = np.empty(len(counts), np.int32)
    ranks[order] = np.arange(len(counts))
    tree, base = tree_of(counts[order])
    model = Model(hashes, ranks[:len(n)], np.zeros((ROWS, CLASSES), np.float32),
                  np.zeros((ROWS, CLASSES, MEMBERS), np.float32), ranks[len(n):], tree, base)
    weight = np.bincount(tree.symbol(ranks), counts + 0.5, SYMBOLS).reshape(CLASSES, MEMBERS)
    model.of_class[0] = log_shares(weight.sum(axis=1)[None])
    model.of_member[0] = log_shares(weight)
    return model


WEIGHTS = "slice int, tokens long, weights binary"


def _slices(model: Model, tokens: int) -> Iterator[pa.RecordBatch]:
    """All weights of a model cut to slices, some at a time."""
    number = 0
    for table in (model.of_class, model.of_member, model.of_step):
        whole = table.ravel()
        for begin in range(0, len(whole), 16 * SLICE):
            parts = [whole[at:at + SLICE].tobytes()
                     for at in range(begin, min(begin + 16 * SLICE, len(whole)), SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(number, number + len(parts)), pa.int32()), pa.array([tokens] * len(parts), pa.int64()),
                 pa.array(parts, pa.binary())], names=["slice", "tokens", "weights"])
            number += len(parts)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean weights of each slice, by tokens."""
    sums: dict[int, list] = {}
    for batch in batches:
        for number, tokens, weights in zip(batch.column("slice").to_pylist(), batch.column("tokens").to_pylist(),
                                           batch.column("weights")):
            held = sums.setdefault(number, [0, 0.0])
            held[0] += tokens
            held[1] = held[1] + tokens * np.frombuffer(weights.as_buffer(), np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([t for t, _ in sums.values()], pa.int64()),
             pa.array([(x / t).astype(np.float32).tobytes() for t, x in sums.values()], pa.binary())],
            names=["slice", "tokens", "weights"])


def train(learning: DataFrame) -> Model:
    """A model from all rows of ``learning`` (doc_id, text).

    The tree and its shares come from counts over all rows. Every task then takes gradient steps
    over all its rows, from the same start; the tasks' weights are averaged by their tokens, slice by slice, so that
    no two whole models meet in one place.
    """
    rows = learning.select("text")
    counted = word_counts(rows)
    hashes, n, others = vocabulary(counted)
    discard(counted)
    start = start_model(hashes, n, others)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(start, of_class=start.of_class.copy(), of_member=start.of_member.copy(),
                      of_step=np.zeros((STEP_ROWS, 1 << STEP), np.float32))
        part, tokens, seen = TaskContext.get().partitionId(), 0, np.zeros(STEP_ROWS, np.float32)
        for number, (_, texts) in enumerate(text_groups(batches, "text")):
            words, lengths = with_ends(texts)
            ranks = own.rank(words)
            symbols = own.tree.symbol(ranks)
            gradient_steps(own, symbols, context(symbols, lengths), (31 * part + number) & 0xFFFF,
                           own.tree.steps(ranks), histories(words, lengths), seen)
            tokens += len(symbols)
        if tokens:
            yield from _slices(own, tokens)

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, (int(n.sum()) + int(others.sum())) // TASK_TOKENS)
    parts = rows.coalesce(tasks).mapInArrow(step, WEIGHTS).repartition(MERGES, "slice").mapInArrow(_averaged, WEIGHTS)
    got = sorted(parts.collect(), key=lambda r: r.slice)
    if not got:
        return replace(start, of_step=np.zeros((STEP_ROWS, 1 << STEP), np.float32))
    whole = np.frombuffer(b"".join(r.weights for r in got), np.float32)
    of_class, of_member, of_step = np.split(whole, np.cumsum([start.of_class.size, start.of_member.size]))
    return replace(start, of_class=of_class.reshape(ROWS, CLASSES), of_member=of_member.reshape(ROWS, CLASSES, MEMBERS),
                   of_step=of_step.reshape(STEP_ROWS, 1 << STEP))


PACKED = ("bucket int, chunk long, docs binary, held binary, tokens binary, model binary, "
          "hashes binary, owners binary, times binary")
ANSWER = ("chunk long, docs binary, held binary, tokens binary, model binary, "
          "n long, v long, owners binary, known binary, base binary, rare binary")
EMPTY = b""


def _pack(model: Model, buckets: int):
    def emit(chunk: int, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        words, lengths = with_ends(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
        distinct, at = np.unique(words, return_inverse=True)
        logs = path_log_probabilities(model, model.rank(distinct)[at], words, lengths) / np.log(10)
        first = np.cumsum(lengths) - lengths
        # Distinct words of each document with their times, by word, then document.
        pairs, times = np.unique((at.astype(np.uint64) << np.uint64(32)) | owner, return_counts=True)
        w, o = distinct[pairs >> np.uint64(32)], pairs.astype(np.uint32)
        times = times.astype(np.uint32)
        # A group of words is in one bucket.
        bucket = group_of(w, len(model.groups)) % buckets
        order = _order(bucket, buckets)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        head = (np.array([x is not None for x in ids]).tobytes()
                + np.array([x or 0 for x in ids], np.int64).tobytes())
        rows = []
        for b in range(buckets):
            at = order[cuts[b]:cuts[b + 1]]
            own = b == chunk % buckets
            if len(at) or own:
                rows.append((
                    b, chunk, head if own else EMPTY, np.array(held, bool).tobytes(),
                    lengths.astype(np.int64).tobytes() if own else EMPTY,
                    np.add.reduceat(logs, first).tobytes() if own else EMPTY,
                    w[at].tobytes(), o[at].tobytes(), times[at].tobytes()))
        names = [f.split()[0] for f in PACKED.split(", ")]
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 7
        for start in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[start:start + 64]), kinds)],
                                             names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        for batch, some in text_groups(batches, "text"):
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            texts += some
            size += sum(len(x or b"") + 64 for x in some)
            if size >= GROUP_BYTES:
                yield from emit(chunk, ids, held, texts)
                chunk += 1
                ids, held, texts, size = [], [], [], 0
        if texts:
            yield from emit(chunk, ids, held, texts)
    return run


def _count(hashes: np.ndarray, groups: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts of one bucket's words over learning documents, and its sums for each document group."""
        rows = table.to_pylist()
        words = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        times = np.concatenate([np.frombuffer(r["times"], np.uint32) for r in rows]).astype(np.int64)
        learned = np.concatenate([~np.frombuffer(r["held"], bool)[np.frombuffer(r["owners"], np.uint32)] for r in rows])
        distinct, inverse = np.unique(words, return_inverse=True)
        counts = np.bincount(inverse, times * learned, len(distinct)).astype(np.int64)
        totals = [int(counts.sum()), int((counts > 0).sum())]
        logs = np.log10(counts + 1.0)
        group, share = group_of(distinct, groups), logs.copy()
        other = ~listed(hashes, distinct)[0]
        together = np.bincount(group, other * (counts + (counts > 0)), groups)
        share -= np.log10(together[group] + 1)
        share[~other] = 0
        out, start = [], 0
        for number, r in enumerate(rows):
            owners = np.frombuffer(r["owners"], np.uint32)
            at, t = inverse[start:start + len(owners)], times[start:start + len(owners)]
            start += len(owners)
            docs = np.flatnonzero(np.bincount(owners))
            known = np.bincount(owners, t * (counts[at] > 0))[docs].astype(np.int64)
            base = np.bincount(owners, t * logs[at])[docs]
            rare = np.bincount(owners, t * share[at])[docs]
            out.append((r["chunk"], r["docs"], r["held"] if r["docs"] else EMPTY, r["tokens"], r["model"],
                        *(totals if not number else [0] * 2), docs.astype(np.uint32).tobytes(), known.tobytes(),
                        base.tobytes(), rare.tobytes()))
        fields = [f.split() for f in ANSWER.split(", ")]
        return pa.table([pa.array(x, pa.int64() if k == "long" else pa.binary())
                         for x, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])
    return run


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def _finish(n: int, v: int):
    def run(table: pa.Table) -> pa.Table:
        """Results of one document group from all buckets' answers."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["docs"])
        tokens = np.frombuffer(head["tokens"], np.int64)
        size = len(tokens)
        present = np.frombuffer(head["docs"][:size], bool)
        ids = np.frombuffer(head["docs"][size:], np.int64)
        known, base, rare = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        for r in sorted(rows, key=lambda r: r["owners"]):
            at = np.frombuffer(r["owners"], np.uint32)
            known[at] += np.frombuffer(r["known"], np.int64)
            base[at] += np.frombuffer(r["base"])
            rare[at] += np.frombuffer(r["rare"])
        base -= tokens * np.log10(n + v + 1.0)
        score = np.frombuffer(head["model"]) + rare
        return pa.table([pa.array(ids, mask=~present), pa.array(np.frombuffer(head["held"], bool)), pa.array(tokens),
                         pa.array(known), pa.array(np.full(size, n)), pa.array(base), pa.array(score)],
                        names=[f.split()[0] for f in RESULT.split(", ")])
    return run


def score(docs: DataFrame, held: Column, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and model log10 probabilities of every row; rows marked by ``held`` are not learned from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. ``held`` is an
    expression over the id column; null means not held.

    Cases: a null, empty or blank text is its end token alone; repeated rows count and are scored each; a null
    id is learned from and scored; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"),
                         F.coalesce(held, F.lit(False)).alias("held"))
    model = train(source.where(~F.col("held")).select("doc_id", "text"))
    buckets = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers = stored(source.mapInArrow(_pack(model, buckets), PACKED).groupBy("bucket")
                     .applyInArrow(_count(model.hashes, len(model.groups)), ANSWER), "lm-answers")
    total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v"))).first()
    return answers.drop("n", "v").groupBy("chunk").applyInArrow(
        _finish(total.n, total.v), RESULT)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that the registered query does not learn from."""
    return remainder(id_column, 7) == 2
