"""Gradient boosting of leaf-limited trees on binned features, for volumes and for log obstruction.

MLlib grows trees by level, has no Poisson loss, no L2 term and finds bins again for every tree. Here
features are binned once, and blocks of rows are kept where they are read. A pass over them adds up
gradients per leaf, feature and bin; the driver holds those sums (leaves x features x bins numbers, set
by parameters), gets a sibling's by subtraction and opens the leaf with the largest gain first.

A pass is a Spark job, which costs more than the few rows of most nodes. So there are few of them: one
asks for sums along the splits of earlier trees, which mostly stay best, and for the rows themselves of
nodes that have few; below those the driver goes on alone. Neither changes a tree.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.config import BoostSettings, ModelSettings
from kerbwatch.session import staged

POISSON, SQUARED = "poisson", "squared_error"
# The log of a forecast volume stays within this range, so that its exponential stays finite.
_LOG_RANGE = 20.0
# Rounds between two writes of the margins; a lost block is made again from the last write.
_ROUNDS_PER_STAGE = 10
BINS = 128
# Rows from which bin edges are taken; all rows are binned.
_EDGE_ROWS = 50_000
# Gradients are added as whole steps of this size, so sums do not depend on the partitions.
_STEPS = float(1 << 20)
_LEAST_HESSIAN = 1e-3
# Tasks of a pass over the training state, and rows for which another task is worth its start.
_PASS_TASKS = 64
_TASK_ROWS = 32_768
# Rows of a node up to which a pass sends them: they take about the bytes of its sums from two tasks.
_SENT_ROWS = 4_096


@dataclass
class Tree:
    """Nodes in order of creation; `feature` is -1 at a leaf, whose `value` is added."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    # Rows it was grown on, by node; not known of a loaded tree.
    rows: list[int] = field(default_factory=lambda: [0], compare=False)

    def split(self, node: int, feature: int, bin_: int, threshold: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin_, threshold
        self.left[node], self.right[node] = left, left + 1
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.rows, 0)):
            column += [empty, empty]
        return left, left + 1

    @property
    def leaves(self) -> int:
        return self.feature.count(-1)

    def leaf_of(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The leaf of every row of features, or of their bins."""
        feature, left, right = (np.array(c) for c in (self.feature, self.left, self.right))
        cut = np.array(self.bin if binned else self.threshold)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            at = node[rows]
            goes_left = x[rows, feature[at]] <= cut[at]
            node[rows] = np.where(goes_left, left[at], right[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def add_to(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x, binned)]


@dataclass
class BoostedTrees:
    """`start` plus the trees: the log of a volume, or log1p of obstruction units."""

    loss: str
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += tree.add_to(x)
        return total

    def forecast(self, margin: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(margin, -_LOG_RANGE, _LOG_RANGE)) if self.loss == POISSON else np.expm1(margin)

    def predict(self, x: Column) -> Column:
        """The forecast for an array of the features, by batches in a Python worker."""

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            return pa.array(self.forecast(self.margin(matrix(values))))

        return score(x)


def matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def held_out_share(share: float, keys: list[str], seed: int) -> Column:
    """Reproducible row choice by hash of the row key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def bin_edges(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of every feature: between neighbouring values where they are few,
    else at quantiles."""
    out = []
    for column in values.T:
        some = np.unique(column)
        if len(some) > bins:
            some = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="midpoint"))
            out.append(some)
        else:
            out.append((some[:-1] + some[1:]) / 2)
    return out


@dataclass
class Block:
    """Some rows of the training state: a byte per feature, and the numbers of each row."""

    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    m: np.ndarray


_BLOCK = "rows long, codes binary, y binary, w binary, held binary, m binary"
_BLOCK_TYPES = (np.uint8, np.float64, np.float64, np.bool_, np.float64)
_SENT_TYPES = (np.int32, np.uint8, np.float64, np.float64)


def _packed(block: Block) -> pa.RecordBatch:
    parts = (block.codes, block.y, block.w, block.held, block.m)
    raw = [pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary()) for a, t in zip(parts, _BLOCK_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([len(block.y)], pa.int64()), *raw], ["rows", "codes", "y", "w", "held", "m"])


def _unpacked(row: tuple) -> Block:
    codes, *numbers = (np.frombuffer(raw, t) for raw, t in zip(row[1:], _BLOCK_TYPES, strict=True))
    return Block(codes.reshape(row[0], -1), *numbers)


def _binned(rows: DataFrame, edges: list[np.ndarray], start: float) -> DataFrame:
    """One row per block: `bins` of its rows in place of `x`, and the margin to start from."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
            y, w, held = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "held"))
            yield _packed(Block(codes, y, w, held, np.full(len(x), start)))

    return rows.mapInArrow(run, _BLOCK)


def _kept(blocks: DataFrame) -> RDD:
    """Written blocks, held by the executors from their first use on; on disk, where memory is short."""
    return blocks.rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def _moved(state: RDD, tree: Tree) -> RDD:
    """The state after one more tree, held like the state."""

    def move(block: Block) -> Block:
        return Block(block.codes, block.y, block.w, block.held, block.m + tree.add_to(block.codes, binned=True))

    return state.map(move).persist(StorageLevel.MEMORY_AND_DISK)


def gradients(loss: str, y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss by the margin."""
    if loss == POISSON:
        mean = np.exp(np.clip(m, -_LOG_RANGE, _LOG_RANGE))
        return w * (mean - y), w * mean
    return w * (m - y), w.copy()


def losses(loss: str, y: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    if loss == POISSON:
        m = np.clip(m, -_LOG_RANGE, _LOG_RANGE)
        return w * (np.exp(m) - y * m)
    return w * (m - y) ** 2 / 2


def _whole(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _STEPS)


def leaf_sums(
    loss: str, codes: np.ndarray, y: np.ndarray, w: np.ndarray, m: np.ndarray, slot: np.ndarray, slots: int, bins: int
) -> np.ndarray:
    """Sums of gradient, curvature and rows: (features, 3, slots, bins); rows of slot -1 are left out."""
    inside = slot >= 0
    g, h = (_whole(a) for a in gradients(loss, y[inside], w[inside], m[inside]))
    return _added(codes[inside], g, h, slot[inside], slots, bins)


def _added(codes: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int, bins: int) -> np.ndarray:
    out = np.empty((codes.shape[1], 3, slots * bins), np.int64)
    for f in range(codes.shape[1]):
        at = slot * bins + codes[:, f]
        for k, weights in enumerate((g, h, None)):
            out[f, k] = np.bincount(at, weights, slots * bins)
    return out.reshape(codes.shape[1], 3, slots, bins)


@dataclass
class NodeRows:
    """All rows of a node with few: their bins, and both derivatives in whole steps."""

    codes: np.ndarray
    g: np.ndarray
    h: np.ndarray
    bins: int

    def sums(self) -> np.ndarray:
        return _added(self.codes, self.g, self.h, np.zeros(len(self.g), np.int64), 1, self.bins)[:, :, 0]

    def cut(self, feature: int, bin_: int) -> tuple[NodeRows, NodeRows]:
        left = self.codes[:, feature] <= bin_
        return tuple(NodeRows(self.codes[some], self.g[some], self.h[some], self.bins) for some in (left, ~left))


def _pass(
    state: RDD, loss: str, tree: Tree, nodes: list[int], features: int, bins: int, small: list[int] | None = None
) -> tuple[np.ndarray, float, dict[int, NodeRows]]:
    """Sums of some leaves of a growing tree, the held-out loss before it, and the rows of `small` leaves.

    Every task adds up its rows. There are few tasks, as what each sends to the driver is
    nodes x features x bins x 24 bytes, and a row only costs a byte per feature.
    """
    small = small or []
    slot_of = np.full(len(tree.feature), -1)
    slot_of[[*nodes, *small]] = np.arange(len(nodes) + len(small))
    size = 3 * max(1, len(nodes)) * bins

    def add(blocks: Iterable[Block]) -> Iterator[tuple[bytes, list[tuple[bytes, ...]]]]:
        total = np.zeros((features + 1, size), np.int64)
        sent = []
        for b in blocks:
            slot = np.where(b.held, -1, slot_of[tree.leaf_of(b.codes, binned=True)])
            if nodes:
                summed = np.where(slot < len(nodes), slot, -1)
                total[:-1] += leaf_sums(loss, b.codes, b.y, b.w, b.m, summed, len(nodes), bins).reshape(features, size)
            total[-1, 0] += int(_whole(losses(loss, b.y[b.held], b.w[b.held], b.m[b.held])).sum())
            if small:
                at = np.flatnonzero(slot >= len(nodes))
                parts = (slot[at] - len(nodes), b.codes[at], *map(_whole, gradients(loss, b.y[at], b.w[at], b.m[at])))
                sent.append(tuple(np.ascontiguousarray(a, t).tobytes() for a, t in zip(parts, _SENT_TYPES, strict=True)))
        yield total.tobytes(), sent

    total = np.zeros((features + 1) * size, np.int64)
    sent = []
    for raw, more in state.mapPartitions(add).collect():
        total += np.frombuffer(raw, np.int64)
        sent += more
    sums = total.reshape(features + 1, 3, -1, bins)
    which, codes, g, h = (np.frombuffer(b"".join(raw), t) for raw, t in zip(zip(*sent) if sent else [()] * 4, _SENT_TYPES, strict=True))
    codes = codes.reshape(-1, features)
    rows = {n: NodeRows(codes[which == k], g[which == k], h[which == k], bins) for k, n in enumerate(small)}
    return sums[:-1, :, : len(nodes)], float(sums[-1].flat[0]) / _STEPS, rows


def best_split(sums: np.ndarray, least_rows: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of a node's best split, from sums of (features, 3, bins); gain 0 for none.

    Rows up to the bin go left. Equal gains go to the first feature and bin.
    """
    g, h, n = (sums[:, k].cumsum(axis=1) for k in range(3))
    g, h = g / _STEPS, h / _STEPS
    all_g, all_h, all_n = (a[:, -1:] for a in (g, h, n))
    right_h = all_h - h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (h + l2) + (all_g - g) ** 2 / (right_h + l2) - all_g**2 / (all_h + l2)
    fits = (n >= least_rows) & (all_n - n >= least_rows) & (h >= _LEAST_HESSIAN) & (right_h >= _LEAST_HESSIAN)
    gain = np.where(fits & np.isfinite(gain), gain, 0.0)
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def leaf_step(sums: np.ndarray, l2: float) -> float:
    """Newton step of a leaf: less its gradients, over its curvature plus `l2`."""
    g, h = sums[0, 0].sum() / _STEPS, sums[0, 1].sum() / _STEPS
    return float(-g / (h + l2)) if h + l2 > 0 else 0.0


def _next_to_open(trial: Tree, splits: dict[int, tuple[float, int, int]], open_leaves: list[int], room: int) -> list[int]:
    """Leaves of the trial tree among the next `room` splits, as far as gains are known."""
    line = [(-splits[i][0], i) for i in open_leaves]
    heapq.heapify(line)
    fresh = []
    for _ in range(room):
        if not line or line[0][0] >= 0:
            break
        node = heapq.heappop(line)[1]
        if trial.feature[node] < 0:
            fresh.append(node)
        else:
            for child in (trial.left[node], trial.right[node]):
                heapq.heappush(line, (-splits[child][0], child))
    return fresh


@dataclass
class Recall:
    """Best splits of nodes in earlier trees, by the way from the root, and the rows of both children.

    Gradients change little in a round, so they are mostly best again.
    """

    splits: dict[tuple, tuple[int, int, float, int, int]] = field(default_factory=dict)

    def open_below(self, trial: Tree, ways: dict[int, tuple], nodes: Iterable[int], room: int, least: int) -> list[int]:
        """Opens nodes with more than `least` rows by what is recalled, at most `room`; the leaves then."""
        line, leaves = deque(nodes), []
        while line:
            node = line.popleft()
            was = self.splits.get(ways[node]) if room and not 0 < trial.rows[node] <= least else None
            if was is None:
                leaves.append(node)
                continue
            children = trial.split(node, *was[:3])
            for side, child in enumerate(children):
                ways[child], trial.rows[child] = (*ways[node], (*was[:2], side)), was[3 + side]
            line += children
            room -= 1
        return leaves


def grow(
    sums_of, edges: list[np.ndarray], boost: BoostSettings, sent_of=None, sent_rows: int = 0, recall: Recall | None = None
) -> tuple[Tree, float]:
    """One tree of at most `max_leaf_nodes` leaves, the leaf with the largest gain opened first.

    `sums_of(tree, nodes)` gives the sums of nodes and the held-out loss. All leaves that are next by
    what is known are opened together on trial, below earlier trials too, so a pass serves many; a trial
    that turns out not to be next is not part of the tree. Only one child of a split is added up, the
    other is the rest. Children of the last split are never opened: the split itself tells their steps.

    `sent_of(tree, nodes, small)`, if given, also gives the rows of nodes with at most `sent_rows`, which
    are opened without a pass. A pass also opens nodes as `recall` has them from earlier trees; where that
    is not the best split of the node, it is closed again.
    """
    recall = recall or Recall()
    trial, ways = Tree(), {0: ()}
    known: dict[int, np.ndarray] = {}
    rows: dict[int, NodeRows] = {}
    splits: dict[int, tuple[float, int, int]] = {}

    def judge(node: int) -> None:
        splits[node] = best_split(known[node], boost.min_samples_leaf, boost.l2_regularization)

    def split(node: int) -> tuple[int, int]:
        _, f, b = splits[node]
        children = trial.split(node, f, b, float(edges[f][b]))
        below = int(known[node][f, 2, : b + 1].sum())
        for side, (child, n) in enumerate(zip(children, (below, _row_count(known[node]) - below), strict=True)):
            ways[child], trial.rows[child] = (*ways[node], (f, b, side)), n
        return children

    def ask(tops: list[int], room: int) -> float:
        """Makes the tops known, or the children of those that are, and what is recalled below."""
        nodes, small, rest = [], [], {}
        made = len(trial.feature)
        for top in tops:
            leaves = recall.open_below(trial, ways, split(top) if top in known else [top], room, sent_rows)
            few = [i for i in leaves if 0 < trial.rows[i] <= sent_rows]
            many = [i for i in leaves if i not in few]
            if top in known and many:
                rest[top] = many.pop(), few + many
            small += few
            nodes += many
            room = max(0, room - len(leaves))
        if sent_of is None:
            sums, held_loss = sums_of(trial, nodes)
        else:
            sums, held_loss, sent = sent_of(trial, nodes, small)
            rows.update(sent)
            known.update((i, r.sums()) for i, r in sent.items())
        known.update((i, sums[:, :, k]) for k, i in enumerate(nodes))
        for top, (last, others) in rest.items():
            known[last] = known[top] - sum(known[i] for i in others)
        for node in [*range(len(trial.feature) - 1, made - 1, -1), *tops]:  # children come after their node
            if node not in known:
                known[node] = known[trial.left[node]] + known[trial.right[node]]
        line = list(tops)
        while line:
            node = line.pop()
            if node not in splits:
                judge(node)
            if trial.feature[node] >= 0 and splits[node][1:] == (trial.feature[node], trial.bin[node]) and splits[node][0] > 0:
                line += (trial.left[node], trial.right[node])
            else:
                trial.feature[node] = -1
        return held_loss

    held_loss = ask([0], boost.max_leaf_nodes - 1)
    open_leaves, chosen = [0], []  # chosen: nodes of the trial tree that are split, in order
    while open_leaves and len(chosen) + 1 < boost.max_leaf_nodes:
        node = max(open_leaves, key=lambda i: (splits[i][0], -i))
        if splits[node][0] <= 0:
            break
        room = boost.max_leaf_nodes - 1 - len(chosen)
        if trial.feature[node] < 0 and room == 1:
            _, f, b = splits[node]
            for child, of_child in zip(split(node), (slice(b + 1), slice(b + 1, None)), strict=True):
                known[child] = known[node][f : f + 1, :, of_child]
        elif trial.feature[node] < 0 and node in rows:
            _, f, b = splits[node]
            left, right = split(node)
            rows[left], rows[right] = rows[node].cut(f, b)
            known[left] = rows[left].sums()
            known[right] = known[node] - known[left]
            judge(left)
            judge(right)
        elif trial.feature[node] < 0:
            ask([i for i in _next_to_open(trial, splits, open_leaves, room) if i not in rows], room)
        open_leaves.remove(node)
        open_leaves += [trial.left[node], trial.right[node]]
        chosen.append(node)
    tree, place = Tree(), {0: 0}
    for node in chosen:
        a, b = tree.split(place[node], trial.feature[node], trial.bin[node], trial.threshold[node])
        place[trial.left[node]], place[trial.right[node]] = a, b
    for node, at in place.items():
        tree.rows[at] = _row_count(known[node])
        if tree.feature[at] < 0:
            tree.value[at] = boost.learning_rate * leaf_step(known[node], boost.l2_regularization)
    for node in chosen:
        if node not in rows:
            counts = (_row_count(known[c]) for c in (trial.left[node], trial.right[node]))
            recall.splits[ways[node]] = (trial.feature[node], trial.bin[node], trial.threshold[node], *counts)
    return tree, held_loss


def _row_count(sums: np.ndarray) -> int:
    return int(sums[0, 2].sum())


class Patience:
    """Ends a fit after `rounds` rounds without a smaller held-out loss, and knows the best size."""

    def __init__(self, rounds: int):
        self.rounds, self.best, self.size = rounds, math.inf, 0

    def out_of(self, loss: float, trees: int) -> bool:
        """Takes the loss of a model of so many trees; true if it is time to end."""
        if loss < self.best:
            self.best, self.size = loss, trees
        return trees - self.size >= self.rounds


def fit_boosted(
    sample: DataFrame, x: Column, y: Column, weight: str, loss: str, boost: BoostSettings, model: ModelSettings, seed: int
) -> BoostedTrees:
    """Fit on `sample`, which has the row keys, the weight and what `x` (array) and `y` refer to.

    Rows set aside for early stopping, by a hash of the key, never enter a tree; a fit that ends early
    goes back to the trees with the smallest held-out loss.
    """
    held = held_out_share(model.validation_fraction, ["zone_id", "window_start"], seed)
    rows = staged(
        sample.select(
            x.alias("x"), y.cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
            (held if model.early_stopping else F.lit(False)).alias("held"), F.xxhash64("zone_id", "window_start").alias("turn"),
        ),
        "boost-sample",
    )
    seen = rows.agg(
        F.count("*").alias("n"), F.sum(F.when(~F.col("held"), F.col("w") * F.col("y"))).alias("wy"),
        F.sum(F.when(~F.col("held"), F.col("w"))).alias("w"),
    ).first()
    mean = (seen["wy"] / seen["w"]) if seen["w"] else 0.0
    start = math.log(max(mean, 1e-9)) if loss == POISSON else mean
    if not seen["w"]:
        return BoostedTrees(loss, start, [])
    share = min(1_000_000, 1_000_000 * _EDGE_ROWS // seen["n"])
    some = rows.filter(F.pmod("turn", F.lit(1_000_000)) < share).select("x").limit(4 * _EDGE_ROWS).toArrow()
    if not len(some):
        some = rows.select("x").limit(_EDGE_ROWS).toArrow()
    edges = bin_edges(matrix(some.column("x").combine_chunks()))
    features, bins = len(edges), 1 + max(map(len, edges))
    tasks = max(1, min(_PASS_TASKS, sample.sparkSession.sparkContext.defaultParallelism, -(-seen["n"] // _TASK_ROWS)))
    rows = rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows.coalesce(min(_PASS_TASKS, -(-seen["n"] // _TASK_ROWS)))
    written = staged(_binned(rows, edges, start), "boost-state")
    state = _kept(written)
    held_states = [state]  # since the last write
    trees: list[Tree] = []
    patience, recall = Patience(model.rounds_without_gain), Recall()
    for _ in range(boost.max_iter):
        tree, held_loss = grow(
            None, edges, boost, lambda t, nodes, small: _pass(state, loss, t, nodes, features, bins, small), _SENT_ROWS, recall
        )
        while len(held_states) > 1:
            held_states.pop(0).unpersist()
        if model.early_stopping and patience.out_of(held_loss, len(trees)):
            break
        if tree.leaves == 1:
            break
        trees.append(tree)
        if len(trees) % _ROUNDS_PER_STAGE:
            state = _moved(state, tree)
        else:
            written = staged(_advanced(written, trees[-_ROUNDS_PER_STAGE:]), "boost-state")
            state = _kept(written)
        held_states.append(state)
    for old in held_states:
        old.unpersist()
    return BoostedTrees(loss, start, trees[: patience.size] if model.early_stopping and len(trees) - patience.size >= patience.rounds else trees)


def _advanced(written: DataFrame, trees: list[Tree]) -> DataFrame:
    """Written blocks with their margins moved by the trees since."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                block = _unpacked(row)
                for tree in trees:
                    block.m = block.m + tree.add_to(block.codes, binned=True)
                yield _packed(block)

    return written.mapInArrow(run, written.schema)
