"""Histogram gradient boosting with leaf-wise growth (M2) on Spark.

Rows are binned once (at most 255 bins a feature and one for missing values) and kept as blocks, one row of Parquet
per few thousand customers: bins (features with few of them packed into shared bytes), label, weight, validation flag, score.  A tree grows best-first:

* one pass over the blocks (a *wave*) routes every row through the tree so far and sums gradients, hessians and rows
  per (leaf, feature, bin) for the smaller child of each leaf that is opened; the sibling is its parent less the child;
* the driver keeps one histogram per open leaf (a sum per bin of each feature, whatever the number of rows) and opens, in a
  wave, every leaf that growth by gain could still reach, so a tree takes about as many passes as it is deep;
* sums are in fixed-point integers, so a tree does not depend on how rows are split or in which order they are added.

A table of one block is grown inside one task by the same code, without a pass per wave; the trees are the same.

Scores are stored every ``STORED`` trees (a written table that cuts the lineage); between them a pass adds the trees
since.  The pass that opens a tree also returns the loss so far, which early stopping watches.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import TARGET
from ..session import remove_scratch, shared_scratch, ship

BINS, MISSING = 256, 255
FIXED = float(1 << 26)
BLOCK_ROWS = 1 << 14
TASK_ROWS = 1 << 20                # rows of a task once every core has one
STORED = 10
DIRECT_SUMS = 64                   # partial sums that the driver adds itself; more are added by tasks first
MIN_HESSIAN = 1e-3
TOLERANCE = 1e-7
STOP_ROWS = 10_000                 # early stopping by default above it
BLOCKS = "bins binary, label binary, weight binary, held binary, score binary"
NODE = ["feature", "threshold", "missing_left", "left", "right", "value"]


# ---------------------------------------------------------------- bins

def _distinct(batches):
    """Values of each feature, none for a feature with too many of them to have a bin each."""
    found: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        found = found or [np.zeros(0)] * x.shape[1]
        for i, column in enumerate(x.T):
            if found[i] is not None:
                values = np.unique(np.concatenate([found[i], column[~np.isnan(column)]]))
                found[i] = values if len(values) < MISSING else None
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)),
                                      pa.array([None if v is None else v.tolist() for v in found], pa.list_(pa.float64()))],
                                     ["feature", "seen"])


def thresholds(rows: DataFrame) -> list[list[float]]:
    """Ascending upper bounds of the bins of each feature of ``rows(x)``: between its values where they are few,
    else its quantiles."""
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen"))))
    found = {r.feature: r for r in rows.select("x").mapInArrow(_distinct, "feature int, seen array<double>").groupBy("feature").agg(
        F.max(F.col("seen").isNull()).alias("many"), seen.alias("seen")).collect()}
    many = [i for i, r in sorted(found.items()) if r.many or len(r.seen) >= MISSING]
    levels = [i / MISSING for i in range(1, MISSING)]
    x = [F.col("x")[i] for i in many]
    cuts = rows.agg(*(F.percentile_approx(F.when(~F.isnan(c), c), levels, 10_000) for c in x)).first() if many else []
    out = [[(a + b) / 2 for a, b in zip(r.seen, r.seen[1:])] for _, r in sorted(found.items())]
    for i, cut in zip(many, cuts):
        out[i] = sorted(set(cut))
    return out


def binned(x: np.ndarray, bounds: list[list[float]]) -> np.ndarray:
    """(features, rows) bins of a (rows, features) matrix; a value equal to a bound lies below it."""
    out = np.empty(x.T.shape, np.uint8)
    for i, b in enumerate(bounds):
        out[i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(np.asarray(b), x[:, i], side="left"))
    return out


class Planes:
    """Features with few bins share a byte of a row: a code in mixed base, one digit a feature, of which the last stands for
    a missing value.  A pass then looks at a plane once for all its features, and blocks are as much smaller."""

    def __init__(self, sizes: list[int]):
        """``sizes``: thresholds of each feature."""
        self.sizes, self.width, codes = tuple(sizes), [n + 2 for n in sizes], []
        self.plane, self.stride = [0] * len(sizes), [1] * len(sizes)
        for f in sorted(range(len(sizes)), key=lambda f: -self.width[f]):
            p = next((p for p, used in enumerate(codes) if used * self.width[f] <= BINS), len(codes))
            codes += [1] * (p == len(codes))
            self.plane[f], self.stride[f] = p, codes[p]
            codes[p] *= self.width[f]
        self.count = len(codes)
        self.digits = [np.arange(BINS) // n % w for n, w in zip(self.stride, self.width)]      # of each code
        self.parts = [(d[:, None] == np.arange(w)).astype(np.float64) for d, w in zip(self.digits, self.width)]

    def __eq__(self, other):
        return isinstance(other, Planes) and self.sizes == other.sizes

    def __hash__(self):
        return hash(self.sizes)

    def __reduce__(self):
        return _planes, (self.sizes,)

    def packed(self, bins: np.ndarray) -> np.ndarray:
        """(planes, rows) codes of (features, rows) bins."""
        out = np.zeros((self.count, bins.shape[1]), np.uint8)
        for f, row in enumerate(bins):
            out[self.plane[f]] += np.minimum(row, np.uint8(self.width[f] - 1)) * np.uint8(self.stride[f])
        return out

    def layout(self, f: int) -> tuple[int, np.ndarray, int]:
        return self.plane[f], self.digits[f], self.width[f] - 1

    def cells(self, total: np.ndarray) -> np.ndarray:
        """(leaves, cells, 3) sums from (planes, 3, leaves, codes); whole numbers, so their order does not matter."""
        return np.concatenate([total[p] @ part for p, part in zip(self.plane, self.parts)], axis=2).transpose(1, 2, 0)


@functools.lru_cache(maxsize=8)
def _planes(sizes: tuple[int, ...]) -> Planes:
    return Planes(sizes)


def _single(f: int) -> tuple[int, np.ndarray, int]:
    """The layout of bins that have a row per feature."""
    return f, np.arange(BINS), MISSING


def _blocked(bounds, first: float, block_rows: int = BLOCK_ROWS, planes: Planes | None = None):
    def run(batches):
        held = []

        def block():
            x, y, w, v = (np.concatenate(c) for c in zip(*held))
            held.clear()
            bins = binned(x, bounds)
            columns = [planes.packed(bins) if planes else bins, y, w, v, np.full(len(y), first)]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns],
                                              ["bins", "label", "weight", "held", "score"])
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                held.append((x, *(part.column(c).to_numpy(zero_copy_only=False).astype(k) for c, k in (
                    ("y", np.float64), ("w", np.float64), ("v", np.uint8)))))
                if sum(len(h[1]) for h in held) >= block_rows:
                    yield block()
        if held:
            yield block()
    return run


# ---------------------------------------------------------------- trees

class Tree:
    """Nodes as parallel lists; ``left`` is -1 at a leaf."""

    def __init__(self):
        self.feature, self.bin, self.missing_left, self.left, self.right, self.value = [], [], [], [], [], []

    def add(self) -> int:
        for column, empty in ((self.feature, 0), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1),
                              (self.value, 0.0)):
            column.append(empty)
        return len(self.left) - 1

    def routes(self, planes: Planes | None = None) -> "Routes":
        return _routes(*map(tuple, (self.feature, self.bin, self.missing_left, self.left, self.right, self.value)), planes)


class Routes:
    """Leaves of rows by bit sets, one bit a leaf: per row of codes (a feature's bins, or a plane) a table code -> leaves
    that its nodes leave open, so a row's leaf is the one bit that all its entries share.  ``layout(feature)`` gives the
    row of codes, the bin of each code and the bin of missing values."""

    def __init__(self, feature, cut, missing_left, left, right, value, layout):
        self.nodes = np.array([n for n in range(len(left)) if left[n] < 0])
        self.values = np.array(value, float)[self.nodes]
        bit = {n: 1 << i for i, n in enumerate(self.nodes.tolist())}
        order = [0]
        for n in order:
            if left[n] >= 0:
                order += [left[n], right[n]]
        for n in reversed(order):
            if left[n] >= 0:
                bit[n] = bit[left[n]] | bit[right[n]]
        every, words = bit[0], -(-len(self.nodes) // 64)
        self.tables: list[dict[int, np.ndarray]] = [{} for _ in range(words)]
        for n in order:
            if left[n] < 0:
                continue
            row, digits, missing = layout(feature[n])
            goes_left = (digits <= cut[n]) & (digits != missing)
            if missing_left[n]:
                goes_left |= digits == missing
            for w, tables in enumerate(self.tables):
                a, b = (np.uint64((every & ~bit[c]) >> 64 * w & 0xFFFFFFFFFFFFFFFF) for c in (right[n], left[n]))
                keep = np.where(goes_left, a, b)
                tables[row] = tables[row] & keep if row in tables else keep

    def places(self, bins) -> np.ndarray:
        """Number of each row's leaf; ``bins`` holds rows of codes."""
        if len(self.nodes) == 1:
            return np.zeros(len(bins[0]), np.int64)
        for w, tables in enumerate(self.tables):
            open_ = None
            for f, table in tables.items():
                one = table.take(bins[f])
                open_ = one if open_ is None else np.bitwise_and(open_, one, out=open_)
            at = (open_.astype(np.float64).view(np.int64) >> 52) - 1023        # exponent of a power of two; -1023: none
            if w:
                out = np.where(open_ > 0, at + 64 * w, out)
            else:
                out = at
        return out

    def leaves(self, bins) -> np.ndarray:
        return self.nodes[self.places(bins)]

    def added(self, bins) -> np.ndarray:
        """Value of each row's leaf."""
        return self.values[self.places(bins)]


@functools.lru_cache(maxsize=64)
def _routes(feature, cut, missing_left, left, right, value, planes) -> Routes:
    """Kept by a worker from wave to wave: a tree is routed by until its values are in the stored scores."""
    return Routes(feature, cut, missing_left, left, right, value, planes.layout if planes else _single)


def gradients(label, weight, score):
    """Fixed-point gradient and hessian of the logistic loss."""
    p = 1 / (1 + np.exp(-score))
    return np.rint(weight * (p - label) * FIXED), np.rint(weight * p * (1 - p) * FIXED)


def loss(label, weight, score) -> float:
    return float(np.rint(weight * (np.logaddexp(0, score) - label * score) * FIXED).sum())


def _arrays(bins, label, weight, held, score):
    label = np.frombuffer(label)
    return (np.frombuffer(bins, np.uint8).reshape(-1, len(label)), label, np.frombuffer(weight),
            np.frombuffer(held, np.uint8).astype(bool), np.frombuffer(score))


def _with_trees(bins, score, routes):
    for one in routes:
        score = score + one.added(bins)
    return score


class Cells:
    """The bins that the features have, one after the other: a feature's bins in order, then that of missing values.
    A feature of two values has three cells, not as many as one of the most."""

    def __init__(self, sizes: list[int]):
        """``sizes``: thresholds of each feature."""
        width = np.array(sizes) + 2
        self.end = np.cumsum(width) - 1                                     # cell of each feature's missing values
        self.feature = np.repeat(np.arange(len(width)), width)
        self.bin = np.arange(len(self.feature)) - (self.end - width + 1)[self.feature]
        self.bin[self.end] = MISSING
        self.taken = self.feature * BINS + self.bin                         # places among BINS bins for every feature
        self.cut = np.flatnonzero(self.bin < MISSING)                       # cells that a split may lie behind
        self.first = slice(0, int(width[0]))                                # any feature's cells hold every row


def histograms(blocks, trees, tree, wanted, cells: Cells, planes: Planes | None = None) -> np.ndarray:
    """Sums (gradient, hessian, rows) per wanted leaf of the tree that grows and cell, and, in the last
    place, the loss and weight of the training and of the validation rows, which the wave of the root alone sums.
    ``planes``: how the blocks' bins are packed (None: a row per feature)."""
    slot = np.full(len(tree.left) + 1, -1)
    slot[wanted] = np.arange(len(wanted))
    growing, before, root = tree.routes(planes), [t.routes(planes) for t in trees], len(tree.left) == 1
    total, ends = None, np.zeros(4)
    for block in blocks:
        bins, label, weight, held, score = _arrays(*block)
        if total is None:
            total = np.zeros((len(bins), 3, len(wanted) * BINS))
        if root:
            score = _with_trees(bins, score, before)
            for i, some in enumerate((~held, held)):
                ends[2 * i:2 * i + 2] += loss(label[some], weight[some], score[some]), np.rint(weight[some] * FIXED).sum()
        at = np.where(held, -1, slot[growing.leaves(bins)])
        rows = np.flatnonzero(at >= 0)
        if not len(rows):
            continue
        if len(rows) < len(at):
            bins, label, weight, score, at = bins[:, rows], label[rows], weight[rows], score[rows], at[rows]
        if not root:                                   # only the rows of the wanted leaves need their scores
            score = _with_trees(bins, score, before)
        g, h = gradients(label, weight, score)
        base = at * BINS
        for f in range(len(bins)):
            cell = base + bins[f]
            for k, values in enumerate((g, h, None)):
                total[f, k] += np.bincount(cell, values, len(wanted) * BINS)
    if total is None:
        return ends.astype(np.int64)
    total = total.reshape(len(total), 3, len(wanted), BINS)
    total = planes.cells(total) if planes else total.transpose(2, 0, 3, 1).reshape(len(wanted), -1, 3)[:, cells.taken]
    return np.concatenate([total.ravel(), ends]).astype(np.int64)


def best_splits(sums: np.ndarray, cells: Cells, l2: float, min_rows: int) -> list:
    """For each leaf of (leaves, cells, 3) sums (gain, feature, bin, missing left, left child's rows) of its best split,
    or None; of equal gains the first feature and bin."""
    def real(part):
        value = part.astype(np.float64)
        value[..., :2] /= FIXED
        return value
    feature = cells.feature[cells.cut]
    lost = sums[:, cells.end][:, feature]
    run = np.cumsum(sums, axis=1)                      # whole numbers: the sums before a feature are taken off exactly
    before = np.concatenate([np.zeros_like(run[:, :1]), run[:, cells.end[:-1]]], axis=1)[:, feature]
    below = run[:, cells.cut] - before
    all_ = real(sums[:, cells.first].sum(1))[:, None]
    best: list = [None] * len(sums)
    for missing_left in (False, True):
        left = real(below + lost if missing_left else below)
        right = all_ - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[..., 0] ** 2 / (left[..., 1] + l2) + right[..., 0] ** 2 / (right[..., 1] + l2)
                    - all_[..., 0] ** 2 / (all_[..., 1] + l2))
        able = ((left[..., 2] >= min_rows) & (right[..., 2] >= min_rows)
                & (left[..., 1] >= MIN_HESSIAN) & (right[..., 1] >= MIN_HESSIAN))
        gain = np.where(able, gain, -np.inf)
        for i, at in enumerate(gain.argmax(1)):
            if gain[i, at] > 0 and (best[i] is None or gain[i, at] > best[i][0]):
                best[i] = (float(gain[i, at]), int(feature[at]), int(cells.bin[cells.cut[at]]), missing_left, int(left[i, at, 2]))
        if not lost[..., 2].any():
            break
    return best


def grow(ask, cells: Cells, max_leaves: int, l2: float, rate: float, min_rows: int) -> tuple[Tree, np.ndarray]:
    """A tree by best-first growth.  ``ask(tree, leaves)`` returns the sums of leaves and the four loss sums."""
    tree = Tree()
    tree.add()
    [root], ends = ask(tree, [0])
    sums = {0: root}
    split = {0: best_splits(root[None], cells, l2, min_rows)[0]}
    children: dict[int, tuple[int, int]] = {}
    while True:
        # growth by gain as far as children are known; what it meets unknown is opened in one wave
        heap = [(-split[0][0], 0)] if split[0] else []
        taken, unknown = 1, []
        while heap and taken < max_leaves:
            gain, node = heapq.heappop(heap)
            taken += 1
            if node not in children:
                unknown.append(node)
                continue
            for child in children[node]:
                if split[child]:
                    heapq.heappush(heap, (-split[child][0], child))
        if not unknown:
            break
        small = {}
        for node in unknown:
            _, tree.feature[node], tree.bin[node], tree.missing_left[node], n = split[node]
            a, b = tree.left[node], tree.right[node] = tree.add(), tree.add()
            children[node] = a, b
            small[node] = a if 2 * n <= int(sums[node][cells.first, 2].sum()) else b
        found, _ = ask(tree, list(small.values()))
        for node, got in zip(small, found):
            a, b = children[node]
            other = b if small[node] == a else a
            sums[small[node]], sums[other] = got, sums.pop(node) - got
        opened = [child for node in unknown for child in children[node]]
        split.update(zip(opened, best_splits(np.stack([sums[child] for child in opened]), cells, l2, min_rows)))
    # nodes that were opened but not reached by growth stay leaves
    kept, order, heap, taken = Tree(), {0: 0}, [(-split[0][0], 0)] if split[0] else [], 1
    kept.add()
    while heap and taken < max_leaves:
        _, node = heapq.heappop(heap)
        taken += 1
        at = order[node]
        kept.feature[at], kept.bin[at], kept.missing_left[at] = tree.feature[node], tree.bin[node], tree.missing_left[node]
        for side, child in zip((kept.left, kept.right), children[node]):
            order[child] = kept.add()
            side[at] = order[child]
            if split[child]:
                heapq.heappush(heap, (-split[child][0], child))
    totals = {}

    def total(node):
        if node in sums:
            return sums[node][cells.first].sum(0)
        if node not in totals:
            totals[node] = sum(total(c) for c in children[node])
        return totals[node]
    for node, at in order.items():
        g, h, _ = total(node)
        kept.value[at] = -rate * (float(g) / FIXED) / (float(h) / FIXED + l2 + 1e-15)
    return kept, ends


# ---------------------------------------------------------------- passes over the blocks

@functools.cache
def _settled() -> None:
    """Once a worker: Spark collects its garbage after every task, which took longer than a wave over a few blocks; what is
    loaded by now stays and needs no look."""
    gc.collect()
    gc.freeze()


def _wave(trees, tree, wanted, cells, planes):
    def run(blocks):
        _settled()
        return [histograms(blocks, trees, tree, wanted, cells, planes)]
    return run


def _added(a, b):
    """Sums of partitions; those of a partition without blocks have the ends only."""
    if len(a) < len(b):
        a, b = b, a
    a = a.copy()
    a[-4:] += b[-4:]
    if len(a) == len(b):
        a[:-4] += b[:-4]
    return a


def _stored(trees, planes):
    def run(batches):
        routes = [t.routes(planes) for t in trees]
        for batch in batches:
            scores = []
            for block in zip(*(map(lambda b: b.as_buffer(), batch.column(c)) for c in range(5))):
                bins, _, _, _, score = _arrays(*block)
                scores.append(_with_trees(bins, score, routes).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.binary())], batch.schema.names)
    return run


def boost(ask, add, cells: Cells, settings: dict) -> dict[str, list[float]]:
    """Grow trees and hand them to ``add`` until there are enough or the validation loss stalls; the losses before
    each tree and after the last."""
    losses: dict[str, list[float]] = {"train": [], "held": []}

    def note(ends):
        for name, (total, weight) in zip(losses, (ends[:2].tolist(), ends[2:].tolist())):
            if weight:
                losses[name].append(total / weight)
    for _ in range(settings["maxIter"]):
        tree, ends = grow(ask, cells, settings["maxLeaves"], settings["l2"], settings["stepSize"], settings["minLeafRows"])
        note(ends)
        if len(tree.left) == 1 or stalled(losses["held"], settings["patience"]):
            return losses
        add(tree)
    stump = Tree()
    stump.add()
    note(ask(stump, [0])[1])
    return losses


def _in_one_task(bounds, first, settings):
    def run(batches):
        sizes = [len(b) for b in bounds]
        trees, since, cells, planes = [], [], Cells(sizes), Planes(sizes)
        blocks = [[c[0].as_buffer() for c in b.columns] for b in _blocked(bounds, first, planes=planes)(batches)]

        def ask(tree, wanted):
            found = histograms(blocks, since, tree, wanted, cells, planes)
            return found[:-4].reshape(len(wanted), -1, 3), found[-4:]

        def add(tree):
            trees.append(tree)
            since.append(tree)
            if len(since) == STORED:
                routes = [t.routes(planes) for t in since]
                for block in blocks:
                    bins, _, _, _, score = _arrays(*block)
                    block[4] = _with_trees(bins, score, routes).tobytes()
                since.clear()
        losses = boost(ask, add, cells, settings)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(exported(trees, bounds))]), pa.array([json.dumps(losses)])],
                                         ["trees", "losses"])
    return run


class Boosting:
    """Blocks in the shared folder and the trees grown so far."""

    def __init__(self, rows: DataFrame, bounds: list[list[float]], first: float, block_rows: int, count: int):
        self.spark, self.trees, self.since = rows.sparkSession, [], []
        self.cells, self.planes = Cells([len(b) for b in bounds]), Planes([len(b) for b in bounds])
        # every core has a share of the blocks; files of a few blocks would be read by one task
        self.tasks = max(1, min(-(-count // block_rows), max(self.spark.sparkContext.defaultParallelism, count // TASK_ROWS)))
        self.store(rows.repartition(self.tasks).mapInArrow(_blocked(bounds, first, block_rows, self.planes), BLOCKS))

    def store(self, blocks: DataFrame) -> None:
        path, old = shared_scratch(self.spark, "boost-blocks"), getattr(self, "path", None)
        blocks.write.parquet(path)
        if old:
            self.blocks.unpersist()
            remove_scratch(self.spark, old)
        self.path = path
        self.table = self.spark.read.schema(BLOCKS).parquet(path).repartition(self.tasks)
        # a wave is a short job over the same few rows: an RDD spares it a query plan of its own
        numbered = self.table.rdd.map(tuple).zipWithIndex().map(lambda p: (p[1], p[0]))
        self.blocks = numbered.partitionBy(self.tasks).values().persist(StorageLevel.MEMORY_AND_DISK)      # as many blocks a task

    def ask(self, tree: Tree, wanted: list[int]):
        sums = self.blocks.mapPartitions(_wave(self.since, tree, wanted, self.cells, self.planes))
        # one array a task
        total = sums.treeReduce(_added) if self.tasks > DIRECT_SUMS else functools.reduce(_added, sums.collect(), np.zeros(4, np.int64))
        shape = (len(wanted), len(self.cells.feature), 3)
        return total[:-4].reshape(shape) if len(total) > 4 else np.zeros(shape, np.int64), total[-4:]

    def add(self, tree: Tree) -> None:
        self.trees.append(tree)
        self.since.append(tree)
        if len(self.since) == STORED:
            self.store(self.table.mapInArrow(_stored(self.since, self.planes), BLOCKS))
            self.since = []

    def close(self) -> None:
        self.blocks.unpersist()
        remove_scratch(self.spark, self.path)


def stalled(losses: list[float], patience: int) -> bool:
    """No one of the last ``patience`` losses is lower than the one before them, by more than a tolerance."""
    return len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - TOLERANCE


# ---------------------------------------------------------------- pyspark.ml stages

class _Shared(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", typeConverter=TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight (empty: 1)", typeConverter=TypeConverters.toString)


class LeafwiseBooster(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Binary classifier.  ``validationIndicatorCol`` names a boolean column of rows that are not learned from and
    stop the growth after ``patience`` trees without improvement; rows with a null label or weight are left out."""

    validationIndicatorCol = Param(Params._dummy(), "validationIndicatorCol", "rows held out (empty: none)",
                                   typeConverter=TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "trees at most", typeConverter=TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", typeConverter=TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "L2 term of leaf values", typeConverter=TypeConverters.toFloat)
    minLeafRows = Param(Params._dummy(), "minLeafRows", "rows of a leaf", typeConverter=TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "trees without improvement", typeConverter=TypeConverters.toInt)
    blockRows = Param(Params._dummy(), "blockRows", "rows of a block", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol: str = "selected", labelCol: str = TARGET, weightCol: str = "", validationIndicatorCol: str = "",
                 maxIter: int = 150, maxLeaves: int = 63, stepSize: float = 0.05, l2: float = 0.1, minLeafRows: int = 20,
                 patience: int = 10, blockRows: int = BLOCK_ROWS):
        super().__init__()
        self._setDefault(featuresCol="selected", labelCol=TARGET, weightCol="", validationIndicatorCol="", maxIter=150, maxLeaves=63,
                         stepSize=0.05, l2=0.1, minLeafRows=20, patience=10, blockRows=BLOCK_ROWS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LeafwiseModel":
        get = self.getOrDefault
        held = F.coalesce(F.col(get("validationIndicatorCol")), F.lit(False)) if get("validationIndicatorCol") else F.lit(False)
        rows = df.select(vector_to_array(F.col(get("featuresCol"))).alias("x"), F.col(get("labelCol")).cast("double").alias("y"),
                         (F.col(get("weightCol")) if get("weightCol") else F.lit(1.0)).cast("double").alias("w"),
                         held.cast("int").alias("v")).filter("y IS NOT NULL AND w IS NOT NULL")
        ship(df.sparkSession)
        path = shared_scratch(df.sparkSession, "boost-rows")       # read for the bins, the base and the blocks
        rows.write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        learned = rows.filter("v = 0")
        total, ones = learned.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
        if not total or not 0 < ones < total:
            raise ValueError("a classifier needs rows of both classes")
        bounds, first = thresholds(learned), float(np.log(ones / (total - ones)))
        settings = {c: get(c) for c in ("maxIter", "maxLeaves", "l2", "stepSize", "minLeafRows", "patience")}
        count = rows.count()
        try:
            if count <= get("blockRows"):
                trees, losses = rows.coalesce(1).mapInArrow(_in_one_task(bounds, first, settings), "trees string, losses string").first()
            else:
                boosting = Boosting(rows, bounds, first, get("blockRows"), count)
                try:
                    losses = json.dumps(boost(boosting.ask, boosting.add, boosting.cells, settings))
                finally:
                    boosting.close()
                trees = json.dumps(exported(boosting.trees, bounds))
        finally:
            remove_scratch(df.sparkSession, path)
        return LeafwiseModel(trees=trees, first=first, losses=losses, featuresCol=get("featuresCol"), maxIter=get("maxIter"))


def exported(trees: list[Tree], bounds: list[list[float]]) -> list[dict]:
    """Trees as node columns with thresholds for raw values (a split at the last bin parts values from missing ones)."""
    out = []
    for t in trees:
        cut = [bounds[f][b] if left >= 0 and b < len(bounds[f]) else float("inf") for f, b, left in zip(t.feature, t.bin, t.left)]
        out.append(dict(zip(NODE, (t.feature, [c if np.isfinite(c) else None for c in cut], t.missing_left, t.left, t.right, t.value))))
    return out


class Forest:
    """Exported trees over bins between the thresholds that they use."""

    def __init__(self, trees: list[dict]):
        cuts: dict[int, set] = {}
        for tree in trees:
            for f, c, left in zip(tree["feature"], tree["threshold"], tree["left"]):
                if left >= 0:
                    cuts.setdefault(f, set()).update(() if c is None else (c,))
        self.cuts = {f: np.array(sorted(c), float) for f, c in cuts.items()}
        sizes = {f: len(c) + 2 for f, c in self.cuts.items()}
        self.routes = []
        for tree in trees:
            at = [0 if left < 0 else len(self.cuts[f]) if c is None else int(np.searchsorted(self.cuts[f], c))
                  for f, c, left in zip(tree["feature"], tree["threshold"], tree["left"])]
            self.routes.append(Routes(tree["feature"], at, tree["missing_left"], tree["left"], tree["right"], tree["value"],
                                      lambda f: (f, np.arange(sizes[f]), sizes[f] - 1)))

    def scores(self, x: np.ndarray, first: float, part: int = 4096) -> np.ndarray:
        """Sum of the trees' values for each row of a (rows, features) matrix."""
        out = []
        for at in range(0, len(x), part):
            some = x[at:at + part]
            bins = {f: np.where(np.isnan(some[:, f]), len(c) + 1, np.searchsorted(c, some[:, f], side="left")) for f, c in self.cuts.items()}
            score = np.full(len(some), first)
            for one in self.routes:
                score = score + (one.added(bins) if len(one.nodes) > 1 else one.values[0])
            out.append(score)
        return np.concatenate(out) if out else np.zeros(0)


class LeafwiseModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability``, a vector of both classes' probabilities."""

    trees = Param(Params._dummy(), "trees", "nodes of each tree (JSON)", typeConverter=TypeConverters.toString)
    losses = Param(Params._dummy(), "losses", "loss before each tree (JSON)", typeConverter=TypeConverters.toString)
    first = Param(Params._dummy(), "first", "score before the first tree", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "trees at most", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, trees: str = "[]", first: float = 0.0, losses: str = "{}", featuresCol: str = "selected", maxIter: int = 150):
        super().__init__()
        self._setDefault(trees="[]", first=0.0, losses="{}", featuresCol="selected", maxIter=150)
        self._set(**self._input_kwargs)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The fitted trees as a table; a null threshold lies above every value."""
        rows = [(i, j, *values) for i, tree in enumerate(json.loads(self.getOrDefault("trees"))) for j, values in enumerate(zip(*(tree[c] for c in NODE)))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double")

    def leaf_rules(self, spark: SparkSession) -> DataFrame:
        """(tree, value, path): the conditions on the way to each leaf, for scoring by a join."""
        rows = []
        for i, tree in enumerate(json.loads(self.getOrDefault("trees"))):
            open_ = [(0, [])]
            while open_:
                node, path = open_.pop()
                if tree["left"][node] < 0:
                    rows.append((i, tree["value"][node], path))
                    continue
                for child, goes_left in ((tree["left"][node], True), (tree["right"][node], False)):
                    open_.append((child, [*path, (tree["feature"][node], tree["threshold"][node], tree["missing_left"][node], goes_left)]))
        return spark.createDataFrame(rows, "tree int, value double, path array<struct<feature: int, threshold: double, "
                                           "missing_left: boolean, goes_left: boolean>>")

    def _walk(self, spark: SparkSession) -> DataFrame:
        """All nodes as one row of arrays, the trees one after the other; a leaf leads to itself.  ``_root`` and ``_steps`` are
        the place of each tree's root and its depth."""
        feature, cut, missing, left, right, value, root, steps = ([] for _ in range(8))
        for tree in json.loads(self.getOrDefault("trees")):
            at, depth = len(left), [0] * len(tree["left"])
            for n, (a, b) in enumerate(zip(tree["left"], tree["right"])):        # children follow their parent
                for child in (a, b) if a >= 0 else ():
                    depth[child] = depth[n] + 1
                left.append(at + (a if a >= 0 else n))
                right.append(at + (b if a >= 0 else n))
            feature += tree["feature"]
            cut += [float("inf") if c is None else float(c) for c in tree["threshold"]]
            missing += [bool(m) for m in tree["missing_left"]]
            value += [float(v) for v in tree["value"]]
            root.append(at)
            steps.append(max(depth))
        return spark.createDataFrame([(feature, cut, missing, left, right, value, root, steps)], "_feature array<int>, _cut array<double>, "
                                     "_missing array<boolean>, _left array<int>, _right array<int>, _value array<double>, _root array<int>, _steps array<int>")

    def scored_by_rules(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``rule_probability`` from the exported nodes by SQL alone, to check the model: every row walks
        through each tree in turn, in one projection beside the broadcast nodes."""
        trees = len(json.loads(self.getOrDefault("trees")))
        if not trees:
            return rows.withColumn("rule_probability", F.lit(1 / (1 + np.exp(-self.getOrDefault("first")))))
        spread = max(rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)    # small files, much work a row
        both = (rows.select(*rows.columns, vector_to_array(F.col(self.getOrDefault("featuresCol"))).alias("_x")).repartition(spread)
                .crossJoin(F.broadcast(self._walk(rows.sparkSession))))
        total = F.expr(f"""aggregate(sequence(0, {trees - 1}), 0D, (s, t) -> s + _value[
            if(_steps[t] = 0, _root[t], aggregate(sequence(1, _steps[t]), _root[t], (n, i) ->
                if(_x[_feature[n]] <= _cut[n] OR (_missing[n] AND isnan(_x[_feature[n]])), _left[n], _right[n])))])""")
        return both.select(*rows.columns, (1 / (1 + F.exp(-(total + self.getOrDefault("first"))))).alias("rule_probability"))

    def history(self) -> dict[str, list[float]]:
        return json.loads(self.getOrDefault("losses"))

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, first = json.loads(self.getOrDefault("trees")), self.getOrDefault("first")

        @F.arrow_udf("double")
        def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forest = Forest(trees)
            for x in batches:
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
                yield pa.array(1 / (1 + np.exp(-forest.scores(rows, first))))

        p = probability(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        return df.withColumn("probability", p).withColumn("probability", array_to_vector(F.array(1 - F.col("probability"), F.col("probability"))))
