"""Training of tree ensembles on binned columns; gives the models of ``pyspark.ml``.

Rows are cut into bins once and kept in blocks of one small number per row and column.  A category is one column however many
indicators its encoding has, since a row has one level at most.  Rows are counted by node, column and bin, and the counts of blocks add up.
Blocks of few bytes go to all tasks, each of which trains trees of its own.  Otherwise every level of the trees is one job for all
ensembles that are trained together.
Rules are those of ``pyspark.ml``: bins by quantiles, features drawn for every node, bootstrap by Poisson counts, Gini or variance
gain, sibling leaves of one prediction merged, and boosting of the logistic loss without line search.
"""

from __future__ import annotations

import json
import pickle
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import enable_checkpoints, scratch_path

#: Rows of a block, and least and most rows of a part.
BLOCK, PART_ROWS, MOST_ROWS = 65_536, 25_000, 4_000_000
#: Trees of a forest that grow at a time, and bytes of their rows' nodes; cells of chances drawn at once.
GROUP, NODE_BYTES, DRAWN = 64, 2 << 30, 1 << 22
#: Bytes of blocks that go to all tasks, if their ensembles of boosting are as many as this share of it.
SHARED_BYTES, ENSEMBLE_BYTES = 64 << 20, 8 << 20
#: Rounds of boosting between two checkpoints, and cells of counts above which they are added up in the tasks.
KEPT_ROUNDS, DRIVER_CELLS = 25, 1 << 20
EPSILON = 2.220446049250313e-16
#: Rows of one block as (key that seeds their chances, bins (column, row), labels, folds).
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray]
#: Poisson(1) counts by a 16-bit chance.
POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this module


@dataclass(frozen=True)
class Layout:
    """Columns of the blocks: the numbers, binned for each view of the rows, then the categories.

    A view is all rows, or all rows but those of one fold: its bins follow from its own rows alone.
    """

    cuts: list[list[np.ndarray]]
    levels: list[int]

    @property
    def numbers(self) -> int:
        return len(self.cuts[0])

    @property
    def features(self) -> int:
        return self.numbers + sum(self.levels)

    def sizes(self, view: int) -> np.ndarray:
        """Bins of each column; one more than its levels for a category, for rows with none of them."""
        return np.array([len(c) + 1 for c in self.cuts[view]] + [n + 1 for n in self.levels], dtype=np.int64)

    def places(self, view: int) -> np.ndarray:
        """Where a block has each column."""
        p = self.numbers
        return np.array([view * p + i for i in range(p)] + [len(self.cuts) * p + j for j in range(len(self.levels))], dtype=np.int64)

    def columns_of_features(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of each feature, and its level there (-1 for a number)."""
        column = [*range(self.numbers)] + [self.numbers + j for j, n in enumerate(self.levels) for _ in range(n)]
        level = [-1] * self.numbers + [k for n in self.levels for k in range(n)]
        return np.array(column, dtype=np.int64), np.array(level, dtype=np.int64)


@dataclass(frozen=True)
class Fit:
    """A model to train: its estimator, the weight of each class, and the fold that it must not see (-1: none)."""

    estimator: object
    weights: tuple[float, float] = (1.0, 1.0)
    fold: int = -1
    view: int = 0


class Grown:
    """A tree as arrays over its nodes, parents before children; a leaf has no ``left`` (-1).

    Values up to ``cut`` go left.  ``stats`` are the weights of both classes (forest), or weight and weighted sum and square of the residuals.
    """

    def __init__(self, stats: np.ndarray, rows: int = 0):
        self.feature, self.left, self.right = (np.full(1, -1, dtype=np.int64) for _ in range(3))
        self.cut, self.gain = np.zeros(1), np.full(1, -1.0)
        self.stats, self.rows = np.array([stats], dtype=float), np.array([rows], dtype=np.int64)

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, stats: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Give the nodes ``at`` two children each, whose stats and rows come in pairs; gives the children's numbers (node, side)."""
        child = len(self.feature) + np.arange(2 * len(at)).reshape(-1, 2)
        self.feature[at], self.cut[at], self.gain[at], self.left[at], self.right[at] = feature, cut, gain, child[:, 0], child[:, 1]
        none = np.full(child.size, -1, dtype=np.int64)
        for name, more in (("feature", none), ("left", none), ("right", none), ("cut", np.zeros(child.size)), ("gain", np.full(child.size, -1.0)),
                           ("stats", stats.reshape(child.size, stats.shape[-1])), ("rows", rows.ravel())):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        return child

    def merged(self, prediction: np.ndarray) -> np.ndarray:
        """Turn inner nodes over two leaves of one prediction into leaves, bottom up; gives the numbers of the nodes that are left."""
        while True:
            inner = np.flatnonzero(self.left >= 0)
            ends = (self.left[self.left[inner]] < 0) & (self.left[self.right[inner]] < 0)
            same = inner[ends & (prediction[self.left[inner]] == prediction[self.right[inner]])]
            if not len(same):
                break
            self.left[same] = self.right[same] = self.feature[same] = -1
            self.gain[same], self.cut[same] = -1.0, 0.0
        found, now = [np.zeros(1, dtype=np.int64)], np.zeros(1, dtype=np.int64)
        while len(now := now[self.left[now] >= 0]):
            now = np.stack([self.left[now], self.right[now]], axis=1).ravel()
            found.append(now)
        return np.concatenate(found)


# --- blocks ----------------------------------------------------------------

def bin_cuts(df: DataFrame, numbers: list[str], bins: int, folds: list[int] | None) -> list[list[np.ndarray]]:
    """For each view the cuts of every number: between all of its values if few, else at quantiles."""
    if not numbers:
        return [[] for _ in folds or [0]]
    few = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(numbers)]).first()
    shares = ", ".join(str(i / bins) for i in range(1, bins))
    views = ["" if folds is None else f" FILTER (WHERE fold <> {f})" for f in folds or [0]]
    asked = [F.expr(f"percentile_approx(`{c}`, array({shares}), 2000){v}").alias(f"q{k}_{i}") for k, v in enumerate(views) for i, c in enumerate(numbers)]
    asked += [F.expr(f"collect_set(`{c}`){v}").alias(f"s{k}_{i}") for k, v in enumerate(views) for i, c in enumerate(numbers) if few[i] <= 2 * bins]
    found = df.agg(*asked).first().asDict()

    def cuts(k: int, i: int) -> np.ndarray:
        values = np.unique(np.array(found.get(f"s{k}_{i}") or [], dtype=float))
        if 0 < len(values) <= bins:
            return (values[1:] + values[:-1]) / 2
        return np.unique(np.array(found[f"q{k}_{i}"] or [], dtype=float))
    return [[cuts(k, i) for i in range(len(numbers))] for k in range(len(views))]


def to_blocks(batches: Iterable[pa.RecordBatch], layout: Layout, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of numbers, levels, label and fold as pickled bins, ``BLOCK`` rows each."""
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        cells = [c.to_numpy() for c in rows.columns]
        p, q = layout.numbers, len(layout.levels)
        if any(c.null_count for c in rows.columns) or any(np.isnan(c).any() for c in cells[:p]):
            raise ValueError("training needs a number in every row; fill the missing ones first")
        bins = np.empty((len(layout.cuts) * p + q, len(rows)), dtype=kind)
        for k, cuts in enumerate(layout.cuts):
            for i, c in enumerate(cuts):
                bins[k * p + i] = np.searchsorted(c, cells[i], side="left")
        for j in range(q):
            bins[len(layout.cuts) * p + j] = np.minimum(cells[p + j], layout.levels[j])
        data = pickle.dumps((bins, cells[-2].astype(np.uint8), cells[-1].astype(np.int16)), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            yield block()
            held.clear()
    if sum(map(len, held)):
        yield block()


def keyed(part: int, rows: Iterable) -> Iterator[Block]:
    for k, row in enumerate(rows):
        yield (part << 24) + k, *pickle.loads(row[0])


def blocks_of(df: DataFrame, numbers: list[str], levels: list[str], layout: Layout) -> tuple[RDD, int]:
    """The kept blocks of a table with numbers, level indices, ``y`` and ``fold``, and how many rows it has."""
    most = max(int(layout.sizes(k).max(initial=1)) for k in range(len(layout.cuts)))
    kind = next(k for k in ("uint8", "uint16", "int32") if most < np.iinfo(k).max)
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(*[f"`{c}`" for c in numbers], *[F.col(f"`{c}`").cast("int") for c in levels], "y", "fold")
    made = rows.mapInArrow(partial(to_blocks, layout=layout, kind=kind), "block binary").rdd
    wanted = max(1, min(-(-n // PART_ROWS), cores), -(-n // MOST_ROWS))
    made = made.coalesce(wanted) if wanted < made.getNumPartitions() else made
    return made.mapPartitionsWithIndex(keyed).persist(StorageLevel.MEMORY_AND_DISK), n


def shared(sc: SparkContext, value: object):
    """A broadcast that tasks read with ``opened``; it carries the code that it needs."""
    return sc.broadcast({"packed": cloudpickle.dumps(value)})


def opened(packed) -> object:
    held = packed.value
    if "value" not in held:
        held["value"] = pickle.loads(held["packed"])
    return held["value"]


def chances(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.SFC64(np.random.SeedSequence([s & 0xFFFFFFFF for s in seed])))


def drawn(layout: Layout, k: int, nodes: int, *seed: int) -> np.ndarray:
    """(node, ``k`` features in order), without repetition."""
    if k >= layout.features:
        return np.broadcast_to(np.arange(layout.features), (nodes, layout.features))
    g, step, out = chances(*seed), max(1, DRAWN // layout.features), []
    for low in range(0, nodes, step):
        some = g.random((min(step, nodes - low), layout.features), dtype=np.float32)
        out.append(np.sort(np.argpartition(some, k - 1, axis=1)[:, :k], axis=1))
    return np.concatenate(out)


# --- forests ---------------------------------------------------------------

@dataclass
class Level:
    """One tree at one level: how many open nodes it has, and how rows of the open nodes before got there."""

    open: int
    column: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    child: np.ndarray | None = None


@dataclass(frozen=True)
class Sprout:
    """A tree of a forest that is to grow."""

    seed: int
    fold: int
    view: int
    weights: tuple[float, float]


def bag(tree: Sprout, block: Block) -> np.ndarray:
    """How often each row is in the tree's bootstrap sample."""
    key, _, y, fold = block
    counts = POISSON[chances(tree.seed, key, 1).integers(0, 1 << 16, len(y), dtype=np.uint16)]
    return np.where(fold == tree.fold, 0, counts) if tree.fold >= 0 else counts


def moved(state: tuple[Block, np.ndarray], trees: list[Sprout], levels: list[Level], layout: Layout) -> tuple[Block, np.ndarray]:
    """The open node of each row in each tree, one level further down; -1 without one."""
    block, before = state
    n, cells = len(block[2]), block[1].ravel()
    now = np.full((len(trees), n), -1, dtype=before.dtype)
    for t, (tree, level) in enumerate(zip(trees, levels, strict=True)):
        if level.open == 0:
            continue
        rows = np.flatnonzero(before[t] >= 0)
        node = before[t][rows]
        bins = cells[(layout.places(tree.view)[level.column] * n)[node] + rows]
        right = (bins > level.low[node]) & (bins <= level.high[node])
        now[t][rows] = level.child.ravel()[2 * node.astype(np.int64) + right]
    return block, now


def started(block: Block, trees: list[Sprout], kind: str) -> tuple[Block, np.ndarray]:
    return block, np.stack([np.where(bag(t, block) > 0, 0, -1).astype(kind) for t in trees])


def slots(layout: Layout, tree: Sprout, k: int, level: int, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Features drawn for each open node, their columns without repetition (-1 after the last), where the counts of each begin, and cells in all."""
    chosen = drawn(layout, k, nodes, tree.seed, level, 2)
    column = layout.columns_of_features()[0][chosen]
    first = np.ones(column.shape, dtype=bool)
    first[:, 1:] = column[:, 1:] != column[:, :-1]
    many = first.sum(axis=1)
    at = np.full((nodes, many.max(initial=0)), -1, dtype=np.int64)
    at[np.arange(at.shape[1])[None, :] < many[:, None]] = column[first]
    cells = np.where(at >= 0, 2 * layout.sizes(tree.view)[at], 0).ravel()
    ends = np.cumsum(cells)
    return chosen, at, many, (ends - cells).reshape(at.shape), int(ends[-1]) if len(ends) else 0


def counted(states: Iterable[tuple[Block, np.ndarray]], trees: list[Sprout], levels: list[Level], layout: Layout, k: int, level: int) -> Iterator[tuple[int, np.ndarray]]:
    """(tree, counts by open node, drawn column, bin and class) of the rows of a part."""
    plans = {t: slots(layout, tree, k, level, levels[t].open) for t, tree in enumerate(trees) if levels[t].open}
    sums = {t: np.zeros(plan[4], dtype=np.uint32) for t, plan in plans.items()}
    for block, nodes in states:
        n = len(block[2])
        # Bin and class in one number, for every column.
        cells = (block[1].astype(np.int32 if block[1].dtype.itemsize > 1 else np.uint16) * 2 + block[2]).ravel()
        for t, (_, at, many, start, size) in plans.items():
            rows = np.flatnonzero(nodes[t] >= 0)
            if not len(rows):
                continue
            node, times = nodes[t].take(rows).astype(np.intp), bag(trees[t], block).take(rows)
            place = (layout.places(trees[t].view) * n)[at.T]
            index, weight = [], []
            for s, (begin, column) in enumerate(zip(start.T.copy(), place, strict=True)):
                if s:
                    more = np.flatnonzero(many.take(node) > s)
                    if len(more) < len(rows):
                        rows, node, times = rows.take(more), node.take(more), times.take(more)
                found = column.take(node)
                found += rows
                found = cells.take(found)
                index.append(begin.take(node))
                index[-1] += found
                weight.append(times)
            np.add.at(sums[t], np.concatenate(index), np.concatenate(weight).astype(np.uint32))
    yield from sums.items()


def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.maximum(a + b, 1e-300)
    return 1.0 - (a / total) ** 2 - (b / total) ** 2


def best_splits(layout: Layout, tree: Sprout, plan: tuple, counts: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The best split of each open node (gain -1 where none is allowed), with its class counts and those of its left child."""
    chosen, at, many, start, _ = plan
    nodes, sizes = len(at), layout.sizes(tree.view)
    column_of, level_of = layout.columns_of_features()
    found: dict[str, list] = defaultdict(list)
    total = np.zeros((nodes, 2))

    def offer(node: np.ndarray, left: np.ndarray, **more: np.ndarray) -> None:
        whole = total[node]
        right = whole - left
        (la, lb), (ra, rb) = (left * tree.weights).T, (right * tree.weights).T
        w, wl, wr = (whole * tree.weights).sum(axis=1), la + lb, ra + rb
        gain = gini(*(whole * tree.weights).T) - wl / w * gini(la, lb) - wr / w * gini(ra, rb)
        allowed = (left.sum(axis=1) >= least) & (right.sum(axis=1) >= least)
        for name, values in (more | {"node": node, "left": left, "gain": np.where(allowed, gain, -1.0)}).items():
            found[name].append(values)

    size = sizes[at[:, 0]]
    for s in np.unique(size):
        some = np.flatnonzero(size == s)
        total[some] = counts[start[some, 0][:, None] + np.arange(2 * s)].reshape(len(some), s, 2).sum(axis=1)
    for c in range(layout.numbers):
        node, slot = np.nonzero(at == c)
        if not len(node) or sizes[c] < 2:
            continue
        cells = counts[start[node, slot][:, None] + np.arange(2 * sizes[c])].reshape(len(node), sizes[c], 2).astype(float)
        left = cells.cumsum(axis=1)[:, :-1].reshape(-1, 2)
        m = sizes[c] - 1
        cut = np.tile(np.arange(m), len(node))
        offer(np.repeat(node, m), left, feature=np.full(len(left), c), column=np.full(len(left), c), low=cut,
              high=np.full(len(left), sizes[c]), cut=layout.cuts[tree.view][c][cut])
    node, slot = np.nonzero(level_of[chosen] >= 0)
    if len(node):
        feature = chosen[node, slot]
        column, level = column_of[feature], level_of[feature]
        place = start[node, (at[node] == column[:, None]).argmax(axis=1)] + 2 * level
        right = counts[place[:, None] + np.arange(2)].astype(float)
        offer(node, total[node] - right, feature=feature, column=column, low=level - 1, high=level, cut=np.full(len(node), 0.5))
    out = {"total": total}
    if not found:
        return out | {"gain": np.full(nodes, -1.0)}
    all_ = {name: np.concatenate(values) for name, values in found.items()}
    order = np.lexsort((all_["feature"], -all_["gain"], all_["node"]))
    first = order[np.r_[True, np.diff(all_["node"][order]) > 0]]
    for name, values in all_.items():
        if name != "node":
            out[name] = np.zeros((nodes, *values.shape[1:]), dtype=values.dtype)
            out[name][all_["node"][first]] = values[first]
    missing = np.ones(nodes, dtype=bool)
    missing[all_["node"][first]] = False
    out["gain"] = np.where(missing, -1.0, out["gain"])
    return out


def splits_of(parts: Iterable[tuple[int, np.ndarray]], trees: list[Sprout], levels: list[Level], layout: Layout, k: int, level: int, least: int) -> Iterator[tuple[int, dict]]:
    sums: dict[int, np.ndarray] = {}
    for t, counts in parts:
        sums[t] = sums[t] + counts if t in sums else counts
    for t, counts in sums.items():
        yield t, best_splits(layout, trees[t], slots(layout, trees[t], k, level, levels[t].open), counts, least)


def grow(tree: Grown, ids: np.ndarray, found: dict[str, np.ndarray], sprout: Sprout, last: bool, least: int) -> tuple[np.ndarray, Level]:
    """Add the splits of the open nodes ``ids`` to a tree; gives the numbers of its new open nodes, and the way there."""
    split = found["gain"] > EPSILON
    if not split.any():
        return ids[:0], Level(0)
    left = found["left"][split]
    counts = np.stack([left, found["total"][split] - left], axis=1)
    child = tree.split(ids[split], found["feature"][split], found["cut"][split], found["gain"][split], counts * sprout.weights,
                       counts.sum(axis=2).astype(np.int64))
    counts = counts.reshape(-1, 2)
    more = (gini(*(counts * sprout.weights).T) >= EPSILON) & (counts.sum(axis=1) >= 2 * least) & (not last)
    order = np.full(len(more), -1, dtype=np.int64)
    order[more] = np.arange(more.sum())
    to = np.full((len(ids), 2), -1, dtype=np.int64)
    to[split] = order.reshape(-1, 2)
    return child.ravel()[more], Level(int(more.sum()), found["column"], found["low"], found["high"], to)


def grow_alone(blocks: list[Block], layout: Layout, sprout: Sprout, depth: int, k: int, least: int) -> Grown:
    """One tree, within a task that has all blocks."""
    tree, ids, level = Grown(np.zeros(2)), np.zeros(1, dtype=np.int64), Level(1)
    states = [started(b, [sprout], "int32") for b in blocks]
    for at in range(depth):
        if at:
            states = [moved(s, [sprout], [level], layout) for s in states]
        for _, splits in splits_of(counted(states, [sprout], [level], layout, k, at), [sprout], [level], layout, k, at, least):
            if not at:
                tree.stats[0], tree.rows[0] = splits["total"][0] * sprout.weights, int(splits["total"][0].sum())
            ids, level = grow(tree, ids, splits, sprout, at + 1 == depth, least)
        if not level.open:
            break
    return tree


def grow_forests(blocks: RDD, rows: int, layout: Layout, trees: list[Sprout], depth: int, k: int, least: int) -> list[Grown]:
    """All trees, a group at a time; one job a level counts and splits the open nodes of the group."""
    kind = "int16" if depth < 16 else "int32"
    size = max(8, min(GROUP, NODE_BYTES // (max(rows, 1) * np.dtype(kind).itemsize)))
    grown, sc = [], blocks.context
    for low in range(0, len(trees), size):
        some = trees[low:low + size]
        made, ids, levels = [Grown(np.zeros(2)) for _ in some], [np.zeros(1, dtype=np.int64) for _ in some], [Level(1) for _ in some]
        state = blocks.map(partial(started, trees=some, kind=kind)).persist(StorageLevel.MEMORY_AND_DISK)
        for at in range(depth):
            plan, before = shared(sc, (some, levels, layout)), None
            if at:
                before, state = state, state.map(lambda s, plan=plan: moved(s, *opened(plan))).persist(StorageLevel.MEMORY_AND_DISK)
            counts = state.mapPartitions(lambda p, plan=plan, at=at: counted(p, *opened(plan), k, at))
            found = counts.partitionBy(min(len(some), state.getNumPartitions()), int).mapPartitions(
                lambda p, plan=plan, at=at: splits_of(p, *opened(plan), k, at, least)).collect()
            if before is not None:
                before.unpersist()
            levels = [Level(0) for _ in some]
            for t, splits in found:
                if not at:
                    made[t].stats[0], made[t].rows[0] = splits["total"][0] * some[t].weights, int(splits["total"][0].sum())
                ids[t], levels[t] = grow(made[t], ids[t], splits, some[t], at + 1 == depth, least)
            plan.unpersist()
            if not any(level.open for level in levels):
                break
        state.unpersist()
        grown += made
    return grown


# --- boosting --------------------------------------------------------------

@dataclass
class Boosted:
    """An ensemble that is boosted: what it is asked to be, and its trees so far."""

    fit: Fit
    depth: int
    rounds: int
    rate: float
    share: float
    seed: int
    features: int
    trees: list[Grown] = field(default_factory=list)


@dataclass
class Way:
    """The tree of this round as far as it has grown, by bins; leaves lead to themselves."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray

    @staticmethod
    def root() -> Way:
        return Way(*(np.zeros(1, dtype=np.int64) for _ in range(3)), np.zeros((1, 2), dtype=np.int64))


def reached(way: Way, block: Block, rows: np.ndarray | None, place: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row gets to."""
    n, cells = len(block[2]), block[1].ravel()
    rows = np.arange(n) if rows is None else rows
    node = np.zeros(len(rows), dtype=np.int64)
    for _ in range(steps):
        bins = cells[(place[way.column] * n)[node] + rows]
        node = way.child.ravel()[2 * node + ((bins > way.low[node]) & (bins <= way.high[node]))]
    return node


def residuals(y: np.ndarray, margin: np.ndarray, at: int) -> np.ndarray:
    """What a tree of boosting is fitted to: the signed labels first, then the negative gradient of the logistic loss."""
    sign = 2.0 * y - 1.0
    return sign if at == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def in_sample(b: Boosted, block: Block, at: int) -> np.ndarray | None:
    """Rows that the tree of round ``at`` is fitted to; None: all."""
    key, _, y, fold = block
    known = fold != b.fit.fold if b.fit.fold >= 0 else None
    if b.share < 1.0:
        taken = chances(b.seed, at, key, 3).random(len(y), dtype=np.float32) < b.share
        known = taken if known is None else known & taken
    return None if known is None else np.flatnonzero(known)


def stepped(state: tuple, ensembles: list[Boosted], at: int, ways: dict[int, tuple[Way, np.ndarray]], layout: Layout) -> tuple:
    """Margins with the trees of round ``at``, which come as what each of their nodes adds.

    With them go (rows, weighted square of the residual) by node, of the rows that each tree was fitted to.
    """
    block, margins, _ = state
    after, leaves = margins.copy(), {}
    for e, (way, value) in ways.items():
        b = ensembles[e]
        node, rows = reached(way, block, None, layout.places(b.fit.view), b.depth), in_sample(b, block, at)
        y, margin, there = (block[2], margins[e], node) if rows is None else (block[2][rows], margins[e][rows], node[rows])
        pull = residuals(y, margin, at)
        leaves[e] = np.stack([np.bincount(there, minlength=len(value)), np.bincount(there, pull * pull * np.array(b.fit.weights)[y], len(value))])
        after[e] += value[node]
    return block, after, leaves


def summed(states: Iterable[tuple], ensembles: list[Boosted], at: int, level: int, asked: dict[int, tuple[Way, np.ndarray]], layout: Layout
           ) -> Iterator[dict]:
    """For each ensemble (weight and weighted residual, asked node, bin) of all columns side by side, over the rows of a part.

    On the first level the sums that came with the margins go along, with keys below zero.
    """
    sums = {}
    for e, (_, slot) in asked.items():
        sums[e] = np.zeros((2, int(slot.max()) + 1, int(layout.sizes(ensembles[e].fit.view).sum())))
    before: dict[int, np.ndarray] = {}
    for block, margins, leaves in states:
        before = before if level else added(before, leaves)
        for e, (way, slot) in asked.items():
            b = ensembles[e]
            sizes, place = layout.sizes(b.fit.view), layout.places(b.fit.view)
            rows, there = in_sample(b, block, at), None
            if level:
                there = slot[reached(way, block, rows, place, level)]
                wanted = np.flatnonzero(there >= 0)
                rows, there = wanted if rows is None else rows[wanted], there[wanted]
            y = block[2] if rows is None else block[2][rows]
            pull = residuals(y, margins[e] if rows is None else margins[e][rows], at)
            weight = None if b.fit.weights == (1.0, 1.0) else np.array(b.fit.weights)[y]
            if weight is not None:
                pull = pull * weight
            nodes, start = sums[e].shape[1], 0
            for c, size in enumerate(sizes.tolist()):
                bins = block[1][place[c]] if rows is None else block[1][place[c]][rows]
                index = bins.astype(np.int64) if there is None else there * size + bins
                sums[e][0, :, start:start + size] += np.bincount(index, weight, nodes * size).reshape(nodes, size)
                sums[e][1, :, start:start + size] += np.bincount(index, pull, nodes * size).reshape(nodes, size)
                start += size
    yield sums | {-1 - e: v for e, v in before.items()}


def added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {e: a[e] + b[e] if e in a and e in b else a.get(e, b.get(e)) for e in a | b}


def boosted_splits(layout: Layout, b: Boosted, sums: np.ndarray, *seed: int) -> dict[str, np.ndarray]:
    """The best split of each node by its sums (weight and residual, node, bin)."""
    sizes = layout.sizes(b.fit.view)
    nodes, start = sums.shape[1], np.cumsum(sizes) - sizes
    column = np.repeat(np.arange(len(sizes)), sizes)
    bins = np.arange(len(column)) - start[column]
    number = column < layout.numbers
    feature = np.where(number, column, np.concatenate([[0], layout.numbers + np.cumsum(layout.levels) - layout.levels]).astype(int)[
        np.where(number, 0, column - layout.numbers + 1)] + bins)
    usable = bins < sizes[column] - 1
    running = np.cumsum(sums, axis=2)
    before = np.concatenate([np.zeros((2, nodes, 1)), running], axis=2)[:, :, start]
    total = running[:, :, sizes[0] - 1] - before[:, :, 0]
    left = np.where(number, running - before[:, :, column], total[:, :, None] - sums)
    right = total[:, :, None] - left
    least = 1e-9 * np.maximum(total[0], 1e-300)[:, None]
    allowed = usable & (left[0] > least) & (right[0] > least)
    if b.features < layout.features:
        open_ = np.zeros((nodes, layout.features + 1), dtype=bool)
        np.put_along_axis(open_, drawn(layout, b.features, nodes, *seed), True, axis=1)
        allowed &= open_[:, np.where(usable, feature, layout.features)]
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(allowed, left[1] ** 2 / left[0] + right[1] ** 2 / right[0], -np.inf)
        base = total[1] ** 2 / total[0]
    best = part.argmax(axis=1)
    own = np.arange(nodes)
    gain = (part[own, best] - base) / np.maximum(total[0], 1e-300)
    # A difference within the rounding of the sums is none.
    gain = np.where(part[own, best] - base > 1e-12 * (1e-6 + np.abs(part[own, best]) + total[0]), gain, -1.0)
    c = column[best]
    cut = np.array([layout.cuts[b.fit.view][k][i] if k < layout.numbers and i < sizes[k] - 1 else 0.5 for k, i in zip(c, bins[best], strict=True)])
    return {"gain": gain, "feature": feature[best], "column": c, "low": np.where(number[best], bins[best], bins[best] - 1),
            "high": np.where(number[best], sizes[c], bins[best]), "cut": cut, "total": total.T, "left": left[:, own, best].T}


class Growing:
    """A tree of boosting while its levels are counted; sums of a larger child are its parent's less its sibling's."""

    def __init__(self, b: Boosted, at: int):
        self.b, self.at, self.tree, self.way = b, at, Grown(np.zeros(2)), Way.root()
        self.open, self.sums, self.asked = np.zeros(1, dtype=np.int64), {}, np.zeros(1, dtype=np.int64)

    def take(self, sums: np.ndarray, level: int, layout: Layout) -> None:
        """The counts of the asked nodes: find the splits of all open nodes and open the next level."""
        held = {i: sums[:, self.asked[i]] for i in self.open.tolist() if self.asked[i] >= 0}
        for i in self.open.tolist():
            if i not in held:
                parent, sibling = self.sums[i]
                held[i] = parent - held[sibling]
        found = boosted_splits(layout, self.b, np.stack([held[i] for i in self.open.tolist()], axis=1), self.b.seed, self.at, level, 4)
        t, w = self.tree, self.way
        if level == 0:
            t.stats[0] = found["total"][0]
        split = found["gain"] > 0
        at, left = self.open[split], found["left"][split]
        stats = np.stack([left, found["total"][split] - left], axis=1)
        child = t.split(at, found["feature"][split], found["cut"][split], found["gain"][split], stats, np.zeros(stats.shape[:2], dtype=np.int64))
        none = np.zeros(child.size, dtype=np.int64)
        w = Way(*(np.concatenate([v, none]) for v in (w.column, w.low, w.high)), np.vstack([w.child, np.repeat(child.reshape(-1, 1), 2, axis=1)]))
        w.column[at], w.low[at], w.high[at], w.child[at] = found["column"][split], found["low"][split], found["high"][split], child
        fewer = (stats[:, 0, 0] > stats[:, 1, 0]).astype(int)
        smaller, larger = child[np.arange(len(at)), fewer], child[np.arange(len(at)), 1 - fewer]
        self.sums = {int(i): (held[int(p)], int(j)) for i, p, j in zip(larger, at, smaller, strict=True)}
        self.way, self.open = w, child.ravel() if level + 1 < self.b.depth else child.ravel()[:0]
        self.asked = np.full(len(t.feature), -1, dtype=np.int64)
        self.asked[smaller] = np.arange(len(smaller))

    def values(self) -> np.ndarray:
        """What each node adds to a margin."""
        return (1.0 if self.at == 0 else self.b.rate) * self.tree.stats[:, 1] / np.maximum(self.tree.stats[:, 0], 1e-300)

    def finish(self, leaves: np.ndarray) -> None:
        """Rows and squares of the leaves, added up to the root."""
        t, sums = self.tree, leaves.T.copy()
        for i in np.flatnonzero(t.left >= 0)[::-1]:
            sums[i] = sums[t.left[i]] + sums[t.right[i]]
        t.rows, t.stats = sums[:, 0].astype(np.int64), np.column_stack([t.stats, sums[:, 1]])
        self.b.trees.append(t)


def with_margins(block: Block, many: int) -> tuple:
    return block, np.zeros((many, len(block[2]))), {}


def only_leaves(states: Iterable[tuple]) -> Iterator[dict]:
    yield reduce(added, (leaves for _, _, leaves in states), {})


class Here:
    """Margins of blocks within one task."""

    def __init__(self, blocks: list[Block], many: int):
        self.states = [with_margins(b, many) for b in blocks]

    def total(self, function, cells: int, **more) -> dict[int, np.ndarray]:
        return reduce(added, function(self.states, **more))

    def step(self, **more) -> None:
        self.states = [stepped(s, **more) for s in self.states]

    def settled(self) -> None:
        pass

    close = settled


class Spread:
    """Margins of blocks in a table that is kept from round to round; every ``KEPT_ROUNDS`` rounds a checkpoint cuts its lineage.

    Each job gets the code from one broadcast.
    """

    def __init__(self, spark: SparkSession, blocks: RDD, many: int):
        enable_checkpoints(spark)
        self.spark, self.rounds, self.before, self.kept, self.fresh = spark, 0, None, None, None
        self.code = shared(blocks.context, {f.__name__: f for f in (summed, stepped, only_leaves)})
        self.state = blocks.map(partial(with_margins, many=many)).persist(StorageLevel.MEMORY_AND_DISK)

    def total(self, function, cells: int, **more) -> dict[int, np.ndarray]:
        """The sum over all parts, in the driver if small, else in the tasks first."""
        code, name, packed = self.code, function.__name__, cloudpickle.dumps(more)
        parts = self.state.mapPartitions(lambda states: opened(code)[name](states, **pickle.loads(packed)))
        return parts.treeReduce(added) if cells > DRIVER_CELLS else reduce(added, parts.collect())

    def step(self, **more) -> None:
        code, packed = self.code, cloudpickle.dumps(more)

        def step(states: Iterable[tuple]) -> Iterator[tuple]:
            given = pickle.loads(packed)
            return (opened(code)["stepped"](s, **given) for s in states)

        self.before, self.state = self.state, self.state.mapPartitions(step).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % KEPT_ROUNDS == 0:
            self.state.checkpoint()
            self.fresh = self.state

    def settled(self) -> None:
        """The margins of this round are there: those of the round before, and the checkpoint before the last, can go."""
        if self.before is not None:
            self.before.unpersist()
        if self.fresh is not None:
            self.drop(self.kept)
            self.kept, self.fresh = self.fresh, None

    def drop(self, state: RDD | None) -> None:
        if state is not None and state.getCheckpointFile():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(state.getCheckpointFile())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.settled()
        self.state.unpersist()
        self.drop(self.kept)


def bare(b: Boosted) -> Boosted:
    """The ensemble as tasks need it."""
    return Boosted(Fit(None, b.fit.weights, b.fit.fold, b.fit.view), b.depth, b.rounds, b.rate, b.share, b.seed, b.features)


def boost(rows: Here | Spread, layout: Layout, ensembles: list[Boosted]) -> None:
    """Grow the trees of all ensembles side by side, counting once for every level of a round."""
    plain, last = [bare(b) for b in ensembles], {}
    for at in range(max(b.rounds for b in plain)):
        trees = {e: Growing(b, at) for e, b in enumerate(ensembles) if at < b.rounds}
        for level in range(max(plain[e].depth for e in trees)):
            asked = {e: (g.way, g.asked) for e, g in trees.items() if len(g.open)}
            if not asked:
                break
            cells = sum(2 * int(slot.max() + 1) * int(layout.sizes(plain[e].fit.view).sum()) for e, (_, slot) in asked.items())
            found = rows.total(summed, cells, ensembles=plain, at=at, level=level, asked=asked, layout=layout)
            if level == 0:
                rows.settled()
                for e, g in last.items():
                    g.finish(found[-1 - e])
            for e in asked:
                trees[e].take(found[e], level, layout)
        last = trees
        rows.step(ensembles=plain, at=at, ways={e: (g.way, g.values()) for e, g in trees.items()}, layout=layout)
    found = rows.total(only_leaves, 0)
    for e, g in last.items():
        g.finish(found[e])
    rows.close()


def boost_alone(blocks: list[Block], layout: Layout, ensemble: Boosted) -> list[Grown]:
    """One ensemble, within a task that has all blocks."""
    boost(Here(blocks, 1), layout, [ensemble])
    return ensemble.trees


# --- models ----------------------------------------------------------------

def node_table(trees: list[Grown], forest: bool) -> pa.Table:
    """The nodes of all trees as ``pyspark.ml`` stores them."""
    parts = defaultdict(list)
    for t, tree in enumerate(trees):
        first, second = tree.stats[:, 0], tree.stats[:, 1]
        prediction = (second > first).astype(float) if forest else second / np.maximum(first, 1e-300)
        impurity = gini(first, second) if forest else np.maximum(tree.stats[:, 2] / np.maximum(first, 1e-300) - prediction ** 2, 0.0)
        at = tree.merged(prediction)
        number = np.full(len(tree.feature), -1, dtype=np.int32)
        number[at] = np.arange(len(at))
        inner = tree.left[at] >= 0
        for name, values in (("tree", np.full(len(at), t)), ("id", np.arange(len(at))), ("prediction", prediction[at]), ("impurity", impurity[at]),
                             ("stats", tree.stats[at].ravel()), ("width", np.full(len(at), tree.stats.shape[1])), ("rows", tree.rows[at]), ("gain", tree.gain[at]),
                             ("left", np.where(inner, number[tree.left[at]], -1)), ("right", np.where(inner, number[tree.right[at]], -1)),
                             ("feature", tree.feature[at]), ("cut", tree.cut[at][inner]), ("cuts", inner)):
            parts[name].append(values)
    cols = {name: np.concatenate(values) for name, values in parts.items()}

    def lists(values: str, sizes: str) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[sizes])], pa.int32()), pa.array(cols[values], pa.float64()))

    def whole(name: str) -> pa.Array:
        return pa.array(cols[name], pa.int32())

    split = pa.StructArray.from_arrays([whole("feature"), lists("cut", "cuts"), pa.array(np.full(len(cols["id"]), -1), pa.int32())],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    node = pa.StructArray.from_arrays(
        [whole("id"), pa.array(cols["prediction"]), pa.array(cols["impurity"]), lists("stats", "width"), pa.array(cols["rows"], pa.int64()),
         pa.array(cols["gain"]), whole("left"), whole("right"), split],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.table({"treeID": whole("tree"), "nodeData": node})


NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
         "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def as_model(spark: SparkSession, estimator: object, trees: list[Grown], features: int) -> object:
    """The trees as the model that the estimator would fit, with its parameters."""
    forest = isinstance(estimator, RandomForestClassifier)
    path, base = scratch_path(spark, "grown"), "org.apache.spark.ml."

    def described(kind: str, uid: str, params: dict, defaults: dict, **more: object) -> str:
        return json.dumps({"class": base + kind, "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": params, "defaultParamMap": defaults, **more})

    params = {p.name: v for p, v in estimator._paramMap.items()}
    defaults = {p.name: v for p, v in estimator._defaultParamMap.items() if p.name not in ("thresholds", "weightCol")}
    own = {k: v for k, v in params.items() if k in ("maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "checkpointInterval", "maxMemoryInMB", "seed")}
    kind = "classification.RandomForestClassificationModel" if forest else "classification.GBTClassificationModel"
    tree = "classification.DecisionTreeClassificationModel" if forest else "regression.DecisionTreeRegressionModel"
    more = {"numFeatures": features, "numTrees": len(trees)} | ({"numClasses": 2} if forest else {})
    rate = 1.0 if forest else estimator.getStepSize()
    spark.createDataFrame([(described(kind, estimator.uid, params, defaults, **more),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    rows = [(t, described(tree, f"{estimator.uid}_{t}", own, {}), rate if t else 1.0) for t in range(len(trees))]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(node_table(trees, forest), NODES).coalesce(1).write.parquet(f"{path}/data")
    return (RandomForestClassificationModel if forest else GBTClassificationModel).load(path)


def fit_trees(df: DataFrame, numbers: list[str], levels: dict[str, int], fits: list[Fit]) -> list[object]:
    """A model for each fit, in their order, all trained on one set of blocks.

    ``df`` has the numbers, for each category the index of its level (``levels`` tells how many there are; a higher one is none),
    ``y`` and ``fold``; the encoded vector has the numbers first, then an indicator for each level.
    """
    spark, folds = df.sparkSession, sorted({f.fold for f in fits})
    if len(folds) > 1 and -1 in folds:
        raise ValueError("fits of all rows and fits of folds are trained apart")
    layout = Layout(bin_cuts(df, numbers, fits[0].estimator.getMaxBins(), None if folds == [-1] else folds), list(levels.values()))
    fits = [Fit(f.estimator, f.weights, f.fold, folds.index(f.fold)) for f in fits]
    blocks, rows = blocks_of(df, numbers, list(levels), layout)
    forests = [f for f in fits if isinstance(f.estimator, RandomForestClassifier)]
    boosted = [Boosted(f, f.estimator.getMaxDepth(), f.estimator.getMaxIter(), f.estimator.getStepSize(), f.estimator.getSubsamplingRate(),
                       f.estimator.getSeed(), drawn_features(f.estimator, layout.features)) for f in fits if isinstance(f.estimator, GBTClassifier)]
    sprouts = [Sprout(f.estimator.getSeed() + 1000 * t, f.fold, f.view, f.weights) for f in forests for t in range(f.estimator.getNumTrees())]
    rules = (forests[0].estimator.getMaxDepth(), int(np.ceil(np.sqrt(layout.features))), forests[0].estimator.getMinInstancesPerNode()) if forests else ()
    try:
        size = blocks.map(lambda b: b[1].nbytes + b[2].nbytes + b[3].nbytes).sum()
        if size <= SHARED_BYTES and (not boosted or size <= ENSEMBLE_BYTES * len(boosted)):
            trees, ensembles = trained_apart(blocks, layout, sprouts, rules, [bare(b) for b in boosted])
        else:
            with ThreadPool(2) as pool:
                ways = [lambda: grow_forests(blocks, rows, layout, sprouts, *rules) if forests else [],
                        lambda: boost(Spread(spark, blocks, len(boosted)), layout, boosted) if boosted else None]
                trees, _ = pool.map(inheritable_thread_target(spark)(lambda train: train()), ways, chunksize=1)
            ensembles = [b.trees for b in boosted]
    finally:
        blocks.unpersist()
    each = iter(trees)
    of_forests = iter([[next(each) for _ in range(f.estimator.getNumTrees())] for f in forests])
    of_boosted = iter(ensembles)
    found = [next(of_forests if f in forests else of_boosted) for f in fits]
    with ThreadPool(min(4, len(fits))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda item: as_model(spark, item[0].estimator, item[1], layout.features)), list(zip(fits, found, strict=True)), chunksize=1)


def trained_apart(blocks: RDD, layout: Layout, sprouts: list[Sprout], rules: tuple, ensembles: list[Boosted]) -> tuple[list[Grown], list[list[Grown]]]:
    """Every ensemble of boosting in a task of its own, the longest first, and the trees of forests in tasks of a few."""
    sc = blocks.context
    held = shared(sc, (blocks.collect(), layout, sprouts, rules, ensembles))
    few = max(1, -(-len(sprouts) // (4 * sc.defaultParallelism)))
    order = sorted(range(len(ensembles)), key=lambda e: -ensembles[e].rounds * ensembles[e].depth)
    tasks = [(True, e, e + 1) for e in order] + [(False, low, min(low + few, len(sprouts))) for low in range(0, len(sprouts), few)]

    def train(task: tuple[bool, int, int]) -> bytes:
        kept, layout, sprouts, rules, ensembles = opened(held)
        boosts, low, high = task
        return cloudpickle.dumps([boost_alone(kept, layout, ensembles[e]) if boosts else grow_alone(kept, layout, sprouts[e], *rules) for e in range(low, high)])

    found = [pickle.loads(f) for f in sc.parallelize(tasks, len(tasks)).map(train).collect()]
    held.unpersist()
    apart = {task[1]: f[0] for task, f in zip(tasks, found, strict=True) if task[0]}
    return [tree for task, f in zip(tasks, found, strict=True) if not task[0] for tree in f], [apart[e] for e in range(len(ensembles))]


def drawn_features(estimator: GBTClassifier, features: int) -> int:
    """How many features a node may use, of strategy ``all`` or a share."""
    strategy = estimator.getFeatureSubsetStrategy()
    return features if strategy == "all" else max(1, min(features, int(np.ceil(float(strategy) * features))))
