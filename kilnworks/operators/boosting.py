"""Gradient-boosted trees on histograms, many models at a time, with the rows spread over the cluster.

Features are cut into at most ``BINS`` bins. Rows lie in blocks of bins, targets and current scores, cached where
they are and rebuilt from a written table if an executor is lost. Trees grow best-first: each pass over the blocks sums
gradients by (leaf, feature, bin) for all leaves that wait, of all models at once. The sums of a leaf meet in one task of a
shuffle, which looks for its split; only that split reaches the driver, whatever the number of rows, tasks and features. A
tree of 31 leaves takes about as many passes as it is deep, as the children of all splits that can still be chosen are
summed in one pass.

Where all rows fit into a task (``WHOLE_ROWS``, ``WHOLE_CELLS``), passes over the cluster cost more than the work in them: there each model grows in
a task of its own, which reads the blocks once. It keeps the rows of each leaf and sums only the smaller of two children; the larger one's sums are
what is left of their parent's. Features that are never at one together, as those of a category, are summed as one.

Models share the blocks. They differ in their settings and in the weight of each row, which follows from a hash of
the row: all rows, all but one fold, or a Poisson number of copies (a resample). Objectives are log loss and quantile loss;
after each tree of a quantile model its leaves get the exact weighted quantile of their residuals. A
constraint of -1 keeps the score from rising with a feature: no split may raise it, and the children of a split
stay on their sides of the middle between their values.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.session import durable

BINS = 64
#: Rows of a block, and of a task at least.
BLOCK_ROWS, TASK_ROWS = 32_768, 4096
#: Rows, and rows by features, up to which a model grows in one task: about half a GB of a worker at most.
WHOLE_ROWS, WHOLE_CELLS = 4_000_000, 96_000_000
#: Rounds after which the blocks of a round become those that later rounds are made from.
KEEP_EVERY = 8
#: Bits of a quantile's place found in a pass, and the weight up to which the residuals themselves are looked at.
DIGIT, FEW = 11, 1024
_POISSON = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.06131324019524039, 0.015328310048810098, 0.003065662009762020,
                      0.0005109436682936699, 0.00007299195261338141, 0.000009123994076672677])


@dataclass(frozen=True)
class Spec:
    """Settings of one model."""
    objective: str = "log_loss"  # or "quantile"
    alpha: float = 0.5
    rounds: int = 350
    rate: float = 0.04
    leaves: int = 31
    depth: int = 64
    least_rows: float = 25
    least_hessian: float = 1e-3
    l2: float = 0.0
    falling: tuple[int, ...] = ()  # features the score may not rise with
    resample: int | None = None  # number of a Poisson resample
    fold: tuple[int, int] | None = None  # (fold left out, number of folds)


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1; rows with bin <= cut go left."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        for name in ("feature", "cut", "left", "right", "value"):
            getattr(self, name).extend([-1, -1] if name == "feature" else [0, 0])
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        return a, a + 1

    def parts(self, bins: np.ndarray, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the numbers of its rows; only the ``wanted`` ones, if named."""
        needed = [wanted is None] * len(self.feature)
        for node in wanted or ():
            needed[node] = True
        if wanted is not None:  # children stand behind their parent
            for node in range(len(needed) - 1, -1, -1):
                if self.feature[node] >= 0:
                    needed[node] = needed[self.left[node]] or needed[self.right[node]]
        todo = [(0, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if not needed[node]:
                continue
            if self.feature[node] < 0:
                yield node, rows
                continue
            goes = bins[:, self.feature[node]].take(rows) <= self.cut[node]
            todo += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.empty(len(bins))
        for leaf, rows in self.parts(bins):
            out[rows] = self.value[leaf]
        return out


@dataclass
class Model:
    spec: Spec
    start: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.asfortranarray(binned(x, self.edges))
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.scores(bins)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return 1 / (1 + np.exp(-raw)) if self.spec.objective == "log_loss" else raw


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.empty((len(x), 0), np.uint8)


def bin_edges(rows: DataFrame, n_features: int, bins: int = BINS) -> list[np.ndarray]:
    """Inner bin edges of each feature of the array ``x``: at most ``bins`` - 1 values each, from a distributed quantile sketch."""
    steps = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[j], steps, 20_000).alias(f"e{j}") for j in range(n_features)],
                   *[F.max(F.col("x")[j]).alias(f"m{j}") for j in range(n_features)]).first()
    edges = [np.unique(np.array(got[f"e{j}"] or [], dtype=float)) for j in range(n_features)]
    return [e[e < got[f"m{j}"]] if len(e) else e for j, e in enumerate(edges)]


def _hashes(ids: np.ndarray, seed: int) -> np.ndarray:
    h = ids.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def folds_of(ids: np.ndarray, folds: int) -> np.ndarray:
    return (_hashes(ids, 999) % np.uint64(folds)).astype(np.int64)


def weights(spec: Spec, ids: np.ndarray) -> np.ndarray:
    """How often a model takes each row."""
    if spec.resample is not None:
        return np.searchsorted(_POISSON, (_hashes(ids, spec.resample) >> np.uint64(11)) / float(1 << 53), side="right").astype(float)
    if spec.fold is not None:
        return (folds_of(ids, spec.fold[1]) != spec.fold[0]).astype(float)
    return np.ones(len(ids))


@dataclass
class _Block:
    bins: np.ndarray  # the bins of a feature lie side by side
    y: np.ndarray
    ids: np.ndarray
    scores: list[np.ndarray]
    columns: list[tuple[np.ndarray, list[int]]]  # what is summed, each with its features

    def after(self, since: list[list[Tree]]) -> "_Block":
        """The block with the scores that it has after some more trees of each model."""
        return replace(self, scores=[sum((t.scores(self.bins) for t in trees), now) for now, trees in zip(self.scores, since)])

    def weights(self, specs: Sequence[Spec]) -> Callable[[int], np.ndarray]:
        """The weights of a model; those that models share are made once."""
        made: dict = {}

        def of(m: int) -> np.ndarray:
            kind = (specs[m].resample, specs[m].fold)
            if kind not in made:
                made[kind] = weights(specs[m], self.ids)
            return made[kind]

        return of


def _packed(rows: DataFrame, edges: list[np.ndarray], n_rows: int) -> DataFrame:
    """Rows (x, y, h) as a table of blocks of bins."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            bins, y, h = (np.concatenate(c) for c in zip(*held))
            return pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in (bins.T, y, h)], names=["bins", "y", "h"])

        held, n = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            held.append((binned(x, edges), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            n += len(x)
            if n >= BLOCK_ROWS:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    few = rows.coalesce(max(1, -(-n_rows // TASK_ROWS)))  # so many rows for each task at least, else small tables pay for empty tasks
    return durable(few.select("x", F.col("y").cast("double"), F.col("h").cast("long")).mapInArrow(pack, "bins binary, y binary, h binary"))


def _unpacked(row: Any, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins by feature, targets and hashes of a block."""
    y = np.frombuffer(row.y, dtype=float)
    return np.frombuffer(row.bins, dtype=np.uint8).reshape(n_features, len(y)), y, np.frombuffer(row.h, dtype=np.int64)


def _blocks(packed: DataFrame, sizes: list[int], n_models: int) -> RDD:
    n_features = len(sizes)
    raw = packed.rdd
    groups = _groups(_settled(raw, lambda row: iter([(0, _together(_unpacked(row, n_features)[0], sizes))]), lambda a, b: a + b, lambda _, t: t, 1)[0], sizes)

    def unpack(row) -> _Block:
        bins, y, ids = _unpacked(row, n_features)
        return _Block(bins.T, y, ids, [np.zeros(len(y))] * n_models, _columns(bins, groups))

    return raw.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _together(bins: np.ndarray, sizes: list[int]) -> np.ndarray:
    """In how many rows two features of two bins are both in the upper one."""
    upper = bins[[j for j, size in enumerate(sizes) if size == 2]].astype(np.float32)
    return (upper @ upper.T).astype(np.int64)


def _groups(together: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Features to be summed at once: those of two bins of which no row has two in the upper one, as those of a category; any other by itself."""
    out = [[j] for j, size in enumerate(sizes) if size != 2]
    two, open_ = [j for j, size in enumerate(sizes) if size == 2], []
    for i in range(len(two)):
        for group in open_:
            if len(group) < 255 and not together[i, group].any():
                break
        else:
            open_.append(group := [])
        group.append(i)
    return out + [[two[i] for i in group] for group in open_]


def _columns(bins: np.ndarray, groups: list[list[int]]) -> list[tuple[np.ndarray, list[int]]]:
    """One column for each group: the bins of its feature, or the place in the group of the feature that is in its upper bin."""
    out = []
    for group in groups:
        column = bins[group[0]]
        if len(group) > 1:
            column = np.zeros(bins.shape[1], np.uint8)
            for k, j in enumerate(group, 1):
                column[bins[j] > 0] = k
        out.append((column, group))
    return out


def _cells_of(group: list[int], sizes: list[int]) -> int:
    return sizes[group[0]] if len(group) == 1 else len(group) + 1


def _told_apart(out: np.ndarray, cells: np.ndarray, group: list[int], first: np.ndarray) -> None:
    """The sums of a column put where the bins of its features stand, along the last axis."""
    if len(group) == 1:
        out[..., first[group[0]]:first[group[0]] + cells.shape[-1]] = cells
        return
    total = cells.sum(axis=-1)
    for k, j in enumerate(group, 1):
        out[..., first[j]] = total - cells[..., k]
        out[..., first[j] + 1] = cells[..., k]


def _settled(blocks: RDD, cells: Callable[[_Block], Iterator[tuple[int, Any]]], add: Callable[[Any, Any], Any], settle: Callable[[int, Any], Any], n: int) -> dict[int, Any]:
    """One pass: ``cells`` of every block by key (below ``n``), added up in each task and, in the order of the tasks, in one place
    for each key. Only what ``settle`` makes of the sums comes to the driver; keys without any cell are missing."""
    def run(task: int, part: Iterator[_Block]) -> Iterator[tuple[int, tuple[int, Any]]]:
        total: dict[int, Any] = {}
        for block in part:
            for key, cell in cells(block):
                total[key] = add(total[key], cell) if key in total else cell
        return ((key, (task, cell)) for key, cell in total.items())

    def end(item: tuple[int, Any]) -> tuple[int, Any]:
        key, parts = item
        return key, settle(key, reduce(add, (cell for _, cell in sorted(parts, key=lambda p: p[0]))))

    sums = blocks.mapPartitionsWithIndex(run)
    if blocks.getNumPartitions() == 1:
        return dict(sums.map(lambda item: end((item[0], [item[1]]))).collect())
    return dict(sums.groupByKey(min(n, blocks.context.defaultParallelism), lambda key: key).map(end).collect())


def _gradients(spec: Spec, y: np.ndarray, score: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.objective == "log_loss":
        p = 1 / (1 + np.exp(-score))
        return (p - y) * w, p * (1 - p) * w
    return np.where(y < score, 1 - spec.alpha, -spec.alpha) * w, w


def _histogram(block: _Block, m: int, spec: Spec, w: np.ndarray, tree: Tree, wanted: list[int], sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Wanted leaves that have rows, each with its sums by (feature, bin): gradients, hessians (where they are not the weights) and weights."""
    g, h = _gradients(spec, block.y, block.scores[m], w)
    place = {node: k for k, node in enumerate(wanted)}
    found = [(place[node], rows) for node, rows in ((node, rows[w[rows] > 0]) for node, rows in tree.parts(block.bins, wanted)) if len(rows)]
    if not found:
        return
    rows = np.concatenate([r for _, r in found])
    leaf = np.repeat(np.arange(len(found)), [len(r) for _, r in found])
    values = [v[rows] for v in ((g, w) if h is w else (g, h, w))]
    out = np.empty((len(found), len(values), sum(sizes)))
    first = np.cumsum([0, *sizes])
    for column, group in block.columns:
        n = _cells_of(group, sizes)
        cell = leaf * n + column.take(rows)
        for i, v in enumerate(values):
            _told_apart(out[:, i], np.bincount(cell, v, len(found) * n).reshape(-1, n), group, first)
    for i, (k, _) in enumerate(found):
        yield k, out[i]


@dataclass
class _Leaf:
    gain: float
    feature: int
    cut: int
    low: float
    high: float
    value: float
    middle: float


@lru_cache(maxsize=8)
def _spread(sizes: tuple[int, ...]) -> np.ndarray:
    """Where the bins of the features stand when each has as many places as the largest."""
    most = max(sizes, default=1)
    return np.concatenate([np.arange(j * most, j * most + size) for j, size in enumerate(sizes)] or [np.arange(0)])


def _best(spec: Spec, sums: np.ndarray, sizes: list[int], low: float, high: float, deep: bool) -> _Leaf:
    """The best split of a leaf by its sums; none if it lies too ``deep``."""
    wide = np.zeros((3, len(sizes), max(sizes, default=1)))
    wide.reshape(3, -1)[:, _spread(tuple(sizes))] = sums[[0, 1, 1]] if len(sums) == 2 else sums
    value = lambda a, b: np.clip(-a / (b + spec.l2 + 1e-300), low, high)
    score = lambda a, b, v: -(2 * a * v + (b + spec.l2) * v * v)
    g, h, n = np.cumsum(wide, axis=2)
    gt, ht, nt = (x[0, -1] if len(x) else 0.0 for x in (g, h, n))
    own = float(value(gt, ht))
    if not deep and len(g):
        gr, hr, nr = gt - g, ht - h, nt - n
        vl, vr = value(g, h), value(gr, hr)
        gain = score(g, h, vl) + score(gr, hr, vr) - score(gt, ht, own)
        bad = (n < spec.least_rows) | (nr < spec.least_rows) | (h < spec.least_hessian) | (hr < spec.least_hessian)
        for j in spec.falling:
            bad[j] |= vl[j] < vr[j]
        gain = np.where(bad, -np.inf, gain)
        j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[j, b] > 1e-12:
            return _Leaf(float(gain[j, b]), int(j), int(b), low, high, own, float(vl[j, b] + vr[j, b]) / 2)
    return _Leaf(0.0, -1, 0, low, high, own, 0.0)


class _Growing:
    """One tree of one model: splits known so far, and the leaves whose sums are wanted."""

    def __init__(self, spec: Spec):
        self.spec, self.tree = spec, Tree()
        self.known: dict[int, _Leaf] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.bounds = {0: (-np.inf, np.inf)}
        self.depth = {0: 0}
        self.wanted = [0]

    def wants(self) -> list[tuple[int, float, float, bool]]:
        """The leaves whose splits are wanted, with the bounds of their values and whether they lie too deep for a split."""
        return [(node, *self.bounds[node], self.depth[node] >= self.spec.depth) for node in self.wanted]

    def learn(self, leaves: list[_Leaf]) -> None:
        """Take in the splits of the wanted leaves, and say which are wanted next."""
        self.known.update(zip(self.wanted, leaves, strict=True))
        self.wanted = []
        self._walk(grow=True)

    def _walk(self, grow: bool) -> list[int]:
        """The splits in the order of their gains; with ``grow`` the children of any that lack sums are wanted."""
        ready, taken = [0] if 0 in self.known else [], []
        while ready and len(taken) < self.spec.leaves - 1:
            node = max(ready, key=lambda i: (self.known[i].gain, -i))
            ready.remove(node)
            if self.known[node].feature < 0:
                continue
            taken.append(node)
            if node not in self.children and grow:
                self.children[node] = self._open(node)
            ready += [c for c in self.children.get(node, ()) if c in self.known]
        return taken

    def _open(self, node: int) -> tuple[int, int]:
        leaf = self.known[node]
        left, right = self.tree.split(node, leaf.feature, leaf.cut)
        falls = leaf.feature in self.spec.falling
        self.bounds[left] = (max(leaf.low, leaf.middle), leaf.high) if falls else (leaf.low, leaf.high)
        self.bounds[right] = (leaf.low, min(leaf.high, leaf.middle)) if falls else (leaf.low, leaf.high)
        self.depth[left] = self.depth[right] = self.depth[node] + 1
        self.wanted += [left, right]
        return left, right

    def finished(self) -> tuple[Tree, dict[int, int]]:
        """The tree of the best splits alone, and the number in it of each of its nodes; splits tried in vain are left out."""
        taken, out, where = set(self._walk(grow=False)), Tree(), {0: 0}
        for node in sorted(taken, key=lambda i: (self.depth[i], i)):
            a, b = out.split(where[node], self.tree.feature[node], self.tree.cut[node])
            where[self.tree.left[node]], where[self.tree.right[node]] = a, b
        for node, at in where.items():
            if node not in taken:
                out.value[at] = self.known[node].value * self.spec.rate
        return out, where


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(float)[0])


def _merged(a: tuple, b: tuple) -> tuple:
    """Two ordered lists of values and their weights as one."""
    values, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([a[1], b[1]]), len(values))


def _leaf_quantiles(blocks: RDD, specs: list[Spec], trees: list[Tree | None]) -> list[list[float] | None]:
    """The weighted quantile of y - score in every leaf of every quantile model: the smallest residual that
    reaches its share of the weight. Eleven bits of its place are found in a pass, until few residuals are left."""
    out: list[list[float] | None] = [None if t is None else [float("nan")] * len(t.feature) for t in trees]
    # by model and leaf: bits known, the place so far, the weight still to reach, whether the residuals themselves are wanted
    open_: dict[tuple[int, int], tuple[int, int, float | None, bool]] = {
        (m, k): (0, 0, None, False) for m, t in enumerate(trees) if t is not None for k, f in enumerate(t.feature) if f < 0}
    while open_:
        asked = list(open_.items())
        number = {at: i for i, (at, _) in enumerate(asked)}
        wanted: dict[int, list[int]] = {}
        for m, k in number:
            wanted.setdefault(m, []).append(k)

        def cells(block: _Block) -> Iterator[tuple[int, tuple]]:
            weight = block.weights(specs)
            for m, leaves in wanted.items():
                keys, w = _ordered(block.y - block.scores[m]), weight(m)
                for k, rows in trees[m].parts(block.bins, leaves):
                    i = number[m, k]
                    bits, place, _, whole = asked[i][1]
                    rows = rows[w[rows] > 0]
                    key = keys[rows]
                    if bits:
                        fits = key >> np.uint64(64 - bits) == np.uint64(place)
                        rows, key = rows[fits], key[fits]
                    if not len(rows):
                        continue
                    if whole:
                        values, at = np.unique(key, return_inverse=True)
                        yield i, (values, np.bincount(at, w[rows], len(values)))
                        continue
                    step = min(DIGIT, 64 - bits)
                    sums = np.bincount((key >> np.uint64(64 - bits - step) & np.uint64((1 << step) - 1)).astype(np.int64), w[rows])
                    values = np.flatnonzero(sums)
                    yield i, (values.astype(np.uint64) | np.uint64(place << step), sums[values])

        def settle(i: int, found: tuple) -> tuple:
            bits, _, goal, whole = asked[i][1]
            values, w = found
            upto = np.cumsum(w)
            goal = specs[asked[i][0][0]].alpha * upto[-1] if goal is None else goal
            at = min(int((upto < goal - 1e-9).sum()), len(values) - 1)
            return 64 if whole else min(64, bits + DIGIT), int(values[at]), float(goal - (upto[at - 1] if at else 0.0)), bool(w[at] <= FEW)

        for i, state in _settled(blocks, cells, _merged, settle, len(asked)).items():
            (m, k), (bits, place, _, _) = asked[i][0], state
            if bits == 64:
                out[m][k] = _double(place)
                del open_[m, k]
            else:
                open_[m, k] = state
        for at, _ in asked:  # leaves without a row
            if at in open_ and not open_[at][0]:
                del open_[at]
    return out


def _grow(blocks: RDD, specs: list[Spec], grown: list[_Growing | None], sizes: list[int]) -> None:
    """One pass: the splits of all wanted leaves."""
    now = [(m, g.tree, g.wants()) for m, g in enumerate(grown) if g and g.wanted]
    first = np.cumsum([0, *(len(k) for _, _, k in now)]).tolist()
    asked = [(m, *rest) for m, _, k in now for _, *rest in k]

    def cells(block: _Block) -> Iterator[tuple[int, np.ndarray]]:
        weight = block.weights(specs)
        for start, (m, tree, leaves) in zip(first, now):
            for k, sums in _histogram(block, m, specs[m], weight(m), tree, [node for node, *_ in leaves], sizes):
                yield start + k, sums

    def settle(i: int, sums: np.ndarray) -> _Leaf:
        m, low, high, deep = asked[i]
        return _best(specs[m], sums, sizes, low, high, deep)

    found = _settled(blocks, cells, lambda a, b: a + b, settle, len(asked))
    nothing = np.zeros((3, sum(sizes)))
    for start, (m, _, leaves) in zip(first, now):
        grown[m].learn([found[i] if i in found else settle(i, nothing) for i in range(start, start + len(leaves))])


class _Whole:
    """All rows that a model learns from, in one task."""

    def __init__(self, spec: Spec, bins: np.ndarray, y: np.ndarray, ids: np.ndarray, sizes: list[int], groups: list[list[int]]):
        w = weights(spec, ids)
        kept = np.flatnonzero(w > 0)
        self.spec, self.sizes, self.w, self.y = spec, sizes, w[kept], y[kept]
        self.bins = bins[:, kept]
        self.columns = _columns(self.bins, groups)
        self.first = np.cumsum([0, *sizes])
        self.alike = bool((self.w == 1).all())

    def sums(self, rows: np.ndarray | None, values: list[np.ndarray]) -> np.ndarray:
        """The sums of each value by (feature, bin), laid out as in :func:`_histogram`."""
        out = np.zeros((len(values), self.first[-1]))
        taken = values if rows is None else [v[rows] for v in values]
        for column, group in self.columns:
            at = (column if rows is None else column[rows]).astype(np.intp)
            for i, v in enumerate(taken):
                _told_apart(out[i], np.bincount(at, v, _cells_of(group, self.sizes)), group, self.first)
        return self.cleared(out)

    @staticmethod
    def cleared(sums: np.ndarray) -> np.ndarray:
        """Nothing in bins without rows: a difference may leave a trace."""
        sums[:, sums[-1] == 0] = 0.0
        return sums

    def quantile(self, residuals: np.ndarray, w: np.ndarray) -> float:
        """As :func:`_leaf_quantiles` has it."""
        n = len(residuals)
        if self.alike:
            at = min(max(int(np.ceil(self.spec.alpha * n - 1e-9)) - 1, 0), n - 1)
            return float(np.partition(residuals, at)[at] + 0.0)
        order = np.argsort(residuals, kind="stable")
        upto = np.cumsum(w[order])
        return float(residuals[order[min(int((upto < self.spec.alpha * upto[-1] - 1e-9).sum()), n - 1)]] + 0.0)

    def tree(self, scores: np.ndarray) -> Tree:
        """The next tree; the scores of the rows are brought forward by it."""
        g, h = _gradients(self.spec, self.y, scores, self.w)
        values = [g, self.w] if h is self.w else [g, h, self.w]
        growing, members, sums = _Growing(self.spec), {0: np.arange(len(self.y))}, {0: self.sums(None, values)}
        opened: set[int] = set()
        while growing.wanted:
            wants = growing.wants()
            growing.learn([_best(self.spec, sums[node], self.sizes, low, high, deep) for node, low, high, deep in wants])
            for node, (left, right) in growing.children.items():
                if node in opened:
                    continue
                opened.add(node)
                rows = members.pop(node)
                goes = self.bins[growing.tree.feature[node]][rows] <= growing.tree.cut[node]
                members[left], members[right] = rows[goes], rows[~goes]
                small, large = (left, right) if len(members[left]) <= len(members[right]) else (right, left)
                sums[small] = self.sums(members[small], values)
                sums[large] = self.cleared(sums.pop(node) - sums[small])
        tree, where = growing.finished()
        # what was opened in vain is still in its children
        below = lambda node: [members[node]] if node in members else [r for c in growing.children[node] for r in below(c)]
        for node, at in where.items():
            if tree.feature[at] < 0:
                rows = np.concatenate(below(node))
                if self.spec.objective == "quantile":
                    tree.value[at] = (self.quantile(self.y[rows] - scores[rows], self.w[rows]) if len(rows) else float("nan")) * self.spec.rate
                scores[rows] += tree.value[at]
        return tree

    def model(self) -> tuple[float, list[Tree]]:
        if self.spec.objective == "quantile":
            start = self.quantile(self.y, self.w) if len(self.y) else float("nan")
        else:
            start = _log_odds(self.w @ self.y, self.w.sum())
        scores = np.full(len(self.y), start)
        return start, [self.tree(scores) for _ in range(self.spec.rounds)]


def _log_odds(positive: float, n: float) -> float:
    rate = min(max(positive / max(n, 1.0), 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def _fit_whole(packed: DataFrame, specs: list[Spec], edges: list[np.ndarray]) -> list[Model]:
    """Each model in a task of its own, which reads all blocks."""
    sizes = [len(e) + 1 for e in edges]

    def grow(m: int, rows: Iterator[Any]) -> Iterator[tuple[int, bytes]]:
        parts = [_unpacked(row, len(sizes)) for row in rows]
        groups = _groups(sum(_together(bins, sizes) for bins, _, _ in parts), sizes)
        bins, y, ids = (np.concatenate(p, axis=-1) for p in zip(*parts))
        parts.clear()
        yield m, pickle.dumps(_Whole(specs[m], bins, y, ids, sizes, groups).model())

    one = packed.rdd.coalesce(1)
    made = dict(one.context.union([one.mapPartitions(partial(grow, m)) for m in range(len(specs))]).collect())
    return [Model(s, start, edges, trees) for s, (start, trees) in ((s, pickle.loads(made[m])) for m, s in enumerate(specs))]


def fit(rows: DataFrame, specs: Sequence[Spec], bins: int = BINS) -> list[Model]:
    """Models of ``rows`` (x: array of doubles without nulls, y, h: a 64-bit hash of the row), all grown side by side."""
    specs = list(specs)
    rows = durable(rows.select("x", "y", "h"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    edges = bin_edges(rows, first["n"], bins)
    sizes = [len(e) + 1 for e in edges]
    n_rows = rows.count()
    packed = _packed(rows, edges, n_rows)
    if specs and n_rows <= WHOLE_ROWS and n_rows * len(edges) <= WHOLE_CELLS:
        return _fit_whole(packed, specs, edges)
    base = _blocks(packed, sizes, len(specs))

    def totals(block: _Block) -> Iterator[tuple[int, np.ndarray]]:
        weight = block.weights(specs)
        return ((m, np.array([(w := weight(m)) @ block.y, w.sum()])) for m in range(len(specs)))

    starts = [0.0] * len(specs)
    for m, t in _settled(base, totals, lambda a, b: a + b, lambda _, t: t, len(specs)).items():
        if specs[m].objective == "log_loss":
            starts[m] = _log_odds(t[0], t[1])
    level = _leaf_quantiles(base, specs, [Tree() if s.objective == "quantile" else None for s in specs])
    starts = [v[0] if v is not None else s for v, s in zip(level, starts)]
    models = [Model(s, b, edges, []) for s, b in zip(specs, starts)]
    since: list[list[Tree]] = [[Tree(value=[b])] for b in starts]

    def with_scores(blocks: RDD, since: list[list[Tree]]) -> RDD:
        return blocks.map(lambda block: block.after(since)).persist(StorageLevel.MEMORY_AND_DISK)

    blocks = with_scores(base, [list(t) for t in since])
    for done in range(max((s.rounds for s in specs), default=0)):
        grown = [_Growing(s) if done < s.rounds else None for s in specs]
        while any(g and g.wanted for g in grown):
            _grow(blocks, specs, grown, sizes)
        trees = [g.finished()[0] if g else None for g in grown]
        renew = [t if t is not None and s.objective == "quantile" else None for t, s in zip(trees, specs)]
        if any(renew):
            for m, values in enumerate(_leaf_quantiles(blocks, specs, renew)):
                if values is not None:
                    leaf = np.array(trees[m].feature) < 0
                    trees[m].value = [v * specs[m].rate if is_leaf else 0.0 for v, is_leaf in zip(values, leaf)]
        for m, t in enumerate(trees):
            if t is not None:
                since[m].append(t)
                models[m].trees.append(t)
        if (done + 1) % KEEP_EVERY == 0:  # what follows is made from this round's blocks
            since = [[t] if t is not None else [] for t in trees]
            base.unpersist()
            base = blocks
        else:
            blocks.unpersist()
        blocks = with_scores(base, [list(t) for t in since])
    base.unpersist()
    return models


def score(models: Sequence[Model], x: str | Column = "x") -> Column:
    """An array of the models' predictions for an array column of features."""
    sent = list(models)

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        made = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(list(np.stack([m.predict(made) for m in sent], axis=1)))

    return run(x)
