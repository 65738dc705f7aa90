"""Leaf-wise gradient boosting for two classes on binned features.

Rows become blocks of binned codes, one a partition, which stay on the executors with each row's margin. A tree grows best leaf first: gradient
histograms of blocks are added up (many by a tree reduction), a sibling's is its parent's less the other child's, and whoever adds them up, which
only sees histograms, picks the splits: the driver, or, where all rows are in one partition, that partition's task, without any job between.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

BINS = 255
#: Rows of a partition at most, and rounds between two checkpoints of the blocks: lost ones are rebuilt from there.
ROWS_A_PART, ROUNDS_A_CHECKPOINT = 1 << 18, 50
#: Where rows are more than a partition's, all cores get some, but none fewer than these.
LEAST_ROWS_A_PART = 1 << 15
#: The least sum of second derivatives in a leaf.
LEAST_CURVATURE = 1e-3

TREES = "tree int, node int, feature int, threshold double, lower int, upper int, value double"


@dataclass
class Boosted:
    """Trees as arrays of nodes: a row goes to ``lower`` where its feature is at most the threshold; leaves have feature -1 and a value."""

    start: float
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for t in self.trees:
            total += t["value"][_leaf(t["feature"], t["threshold"], t["lower"], t["upper"], x)]
        return total

    def probability(self, features: list[str]) -> Column:
        """The class-1 probability, from double columns in the order of training."""

        @F.pandas_udf("double")
        def run(rows: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.margins(np.stack(rows.to_numpy()))))) if len(rows) else pd.Series([], dtype=float)

        return run(F.array(*[F.col(f).cast("double") for f in features]))

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each node of each tree; tree -1 has the start value."""
        rows = [(-1, 0, -1, 0.0, -1, -1, float(self.start))]
        for i, t in enumerate(self.trees):
            rows += [(i, j, int(t["feature"][j]), float(t["threshold"][j]), int(t["lower"][j]), int(t["upper"][j]), float(t["value"][j])) for j in range(len(t["value"]))]
        spark.createDataFrame(rows, TREES).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        rows = spark.read.schema(TREES).parquet(path).orderBy("tree", "node").toPandas()
        trees = [{c: g[c].to_numpy() for c in ("feature", "threshold", "lower", "upper", "value")} for i, g in rows.groupby("tree") if i >= 0]
        return Boosted(float(rows.loc[rows["tree"] == -1, "value"].iloc[0]), trees)


def _leaf(feature: np.ndarray, threshold: np.ndarray, lower: np.ndarray, upper: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node at which each row of x ends."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= threshold[node], lower[node], upper[node])
    return at


#: States of features that are coded together, at most: flags and small counts share a code, and their sums are told apart afterwards.
STATES = 512
#: Rows of a binned piece, and partitions whose sums are added up without a stage between.
PIECE_ROWS, PARTS_AT_ONCE = 1 << 12, 16
#: Rows of which one task grows all trees, at most (about 50 bytes each, as codes): a job a wave takes longer up to there.
ROWS_A_TASK = 1 << 21


class Layout:
    """How features are coded: groups of features whose bins make one number, and where each feature's bins are in a row of sums."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges, self.bins = edges, [len(e) for e in edges]
        self.first = np.append(0, np.cumsum(self.bins))
        self.groups: list[list[int]] = []
        states = 1
        for f in sorted(range(len(edges)), key=lambda f: self.bins[f]):
            if not self.groups or states * self.bins[f] > STATES:
                self.groups.append([])
                states = 1
            self.groups[-1].append(f)
            states *= self.bins[f]
        self.states = [int(np.prod([self.bins[f] for f in g])) for g in self.groups]
        self.place = {f: (i, int(np.prod([self.bins[x] for x in g[j + 1 :]], dtype=np.int64))) for i, g in enumerate(self.groups) for j, f in enumerate(g)}
        self.columns = [np.concatenate([np.arange(self.first[f], self.first[f + 1]) for f in g]) for g in self.groups]
        # Of each group which states are in which bins: a group's sums times this are its features' sums.
        self.parts = [None if len(g) == 1 else np.column_stack([self._bin(f)[:, None] == np.arange(self.bins[f]) for f in g]).astype(float) for g in self.groups]

    def _bin(self, f: int) -> np.ndarray:
        i, stride = self.place[f]
        return np.arange(self.states[i]) // stride % self.bins[f]

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """A row for each group, from the features' values."""
        out = np.zeros((len(self.groups), len(columns[0])), np.uint16)
        for i, g in enumerate(self.groups):
            for f in g:
                out[i] = out[i] * self.bins[f] + np.minimum(np.searchsorted(self.edges[f], columns[f]), self.bins[f] - 1)
        return out

    def lower(self, f: int, cut: int) -> tuple[int, np.ndarray]:
        """A feature's group, and which of its states are at most the cut."""
        return self.place[f][0], self._bin(f) <= cut


@dataclass
class Block:
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray

    def after(self, layout: Layout, tree: dict[str, np.ndarray]) -> Block:
        return Growth(self, layout).added(tree)


class Growth:
    """A block while a tree grows: rows of the nodes that were asked for, and gradients."""

    def __init__(self, block: Block, layout: Layout):
        self.block, self.layout = block, layout
        self.rows: dict[int, np.ndarray | None] = {0: None}  # null: all
        self.slopes: tuple[np.ndarray, np.ndarray] | None = None

    def _rows(self, tree: dict[str, np.ndarray], above: dict[int, int], node: int) -> np.ndarray | None:
        if node not in self.rows:
            up = above[node]
            rows = self._rows(tree, above, up)
            group, lower = self.layout.lower(int(tree["feature"][up]), int(tree["cut"][up]))
            codes = self.block.codes[group]
            low = lower[codes if rows is None else codes[rows]]
            for child, mine in ((int(tree["lower"][up]), low), (int(tree["upper"][up]), ~low)):
                self.rows[child] = np.flatnonzero(mine) if rows is None else rows[mine]
        return self.rows[node]

    def sums(self, tree: dict[str, np.ndarray], nodes: list[int]) -> np.ndarray:
        """Of each of the nodes, over all features' bins behind each other: sums of gradients, of second derivatives, and rows."""
        b, above = self.block, _above(tree)
        if self.slopes is None:
            p = 1 / (1 + np.exp(-b.margin))
            self.slopes = (p - b.label) * b.weight, p * (1 - p) * b.weight
        out = np.zeros((len(nodes), 3, int(self.layout.first[-1])))
        for node, to in zip(nodes, out, strict=True):
            rows = self._rows(tree, above, node)
            g, h = self.slopes if rows is None else (x[rows] for x in self.slopes)
            for codes, states, columns, parts in zip(b.codes, self.layout.states, self.layout.columns, self.layout.parts, strict=True):
                c = (codes if rows is None else codes[rows]).astype(np.intp)
                found = np.stack([np.bincount(c, w, states) for w in (g, h, None)])
                to[:, columns] = found if parts is None else found @ parts
        return out

    def added(self, tree: dict[str, np.ndarray]) -> Block:
        """The block with a tree's values in the margins."""
        b, above, margin = self.block, _above(tree), self.block.margin.copy()
        for node in [0, *above]:
            if tree["feature"][node] < 0:
                rows = self._rows(tree, above, node)
                margin[slice(None) if rows is None else rows] += tree["value"][node]
        return Block(b.codes, b.label, b.weight, margin)


def _above(tree: dict[str, np.ndarray]) -> dict[int, int]:
    """The parent of each node of a tree but the root."""
    return {int(child): int(up) for up in np.flatnonzero(tree["feature"] >= 0) for child in (tree["lower"][up], tree["upper"][up])}


class Gathered:
    """All blocks in one place, where a sum costs no more than its rows: nothing is guessed."""

    at_once = 1

    def __init__(self, blocks: list[Block], layout: Layout):
        self.growing, self.layout = [Growth(b, layout) for b in blocks], layout

    def sums(self, tree: dict[str, np.ndarray], nodes: list[int]) -> np.ndarray:
        return sum((g.sums(tree, nodes) for g in self.growing), np.zeros((len(nodes), 3, int(self.layout.first[-1]))))

    def add(self, tree: dict[str, np.ndarray]) -> None:
        self.growing = [Growth(g.added(tree), self.layout) for g in self.growing]


class Spread:
    """Blocks on the executors: a sum is a job."""

    at_once = 1 << 10

    def __init__(self, blocks: RDD, layout: Layout):
        self.blocks, self.before, self.rounds = blocks, None, 0
        self.parts, self.layout = blocks.getNumPartitions(), blocks.context.broadcast(layout)

    def sums(self, tree: dict[str, np.ndarray], nodes: list[int]) -> np.ndarray:
        layout = self.layout
        found = self.blocks.mapPartitions(lambda blocks: [Gathered(list(blocks), layout.value).sums(tree, nodes)])
        found = sum(found.collect()) if self.parts <= PARTS_AT_ONCE else found.treeReduce(np.add)
        if self.before is not None:  # the new blocks are there now
            self.before.unpersist()
            self.before = None
        return found

    def add(self, tree: dict[str, np.ndarray]) -> None:
        layout = self.layout
        self.before, self.blocks = self.blocks, self.blocks.map(lambda block: block.after(layout.value, tree)).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % ROUNDS_A_CHECKPOINT == 0:
            self.blocks.checkpoint()


class Growing:
    """One tree: splits that are known, and those that would be made first."""

    def __init__(self, edges: list[np.ndarray], first: np.ndarray, leaves: int, least_rows: int, root: np.ndarray):
        self.edges, self.first, self.leaves, self.least_rows = edges, first, leaves, least_rows
        self.at_most = np.concatenate([np.arange(n) for n in np.diff(first)])
        self.of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.sums = {0: root}
        self.splits: dict[int, tuple] = {}
        self.below: dict[int, tuple[int, int]] = {}
        self.nodes = 1
        self._best(0)

    def _best(self, node: int) -> None:
        """The best split of a node with its gain, the smaller side and that side's rows."""
        g, h, n = self.sums[node]
        left = []
        for x in (g, h, n):
            c = np.cumsum(x)
            left.append(c - np.repeat(np.append(0, c[self.first[1:-1] - 1]), np.diff(self.first)))
        total = [x[: self.first[1]].sum() for x in (g, h, n)]
        right = [t - x for t, x in zip(total, left, strict=True)]
        ok = (left[2] >= self.least_rows) & (right[2] >= self.least_rows) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1], -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > 1e-12:
            self.splits[node] = (float(gain[i]), int(self.of[i]), int(self.at_most[i]), bool(left[2][i] <= right[2][i]))

    def wanted(self, at_once: int) -> list[int]:
        """Best leaf first as far as gains are known; then the nodes whose children may be next, best first, to be measured together: so many at most."""
        order, room = [(-self.splits[0][0], 0)] if 0 in self.splits else [], self.leaves - 1
        self.made: list[int] = []
        open_: list[int] = []
        while order and room:
            _, node = heapq.heappop(order)
            room -= 1
            if node not in self.below:
                open_.append(node)  # what its children gain isn't known: all that follow are guesses
                if len(open_) == at_once:
                    break
                continue
            if not open_:
                self.made.append(node)
            for child in self.below[node]:
                if child in self.splits:
                    heapq.heappush(order, (-self.splits[child][0], child))
        return open_

    def split(self, nodes: list[int]) -> list[int]:
        """Gives each of the nodes its children; returns the smaller ones."""
        small = []
        for node in nodes:
            self.below[node] = (self.nodes, self.nodes + 1)
            small.append(self.nodes + (not self.splits[node][3]))
            self.nodes += 2
        return small

    def measured(self, nodes: list[int], sums: np.ndarray) -> None:
        for node, s in zip(nodes, sums, strict=True):
            a, b = self.below[node]
            small, large = (a, b) if self.splits[node][3] else (b, a)
            self.sums[small], self.sums[large] = s, self.sums[node] - s
            self._best(a)
            self._best(b)

    def tree(self, step: float, chosen: set[int] | None = None) -> dict[str, np.ndarray]:
        """The nodes so far as arrays: all that are measured, or only the chosen splits."""
        n = self.nodes
        t = {"feature": np.full(n, -1), "cut": np.zeros(n, np.int64), "threshold": np.zeros(n), "lower": np.full(n, -1), "upper": np.full(n, -1), "value": np.zeros(n)}
        for node, (lower, upper) in self.below.items():
            if chosen is None or node in chosen:
                _, f, cut, _ = self.splits[node]
                t["feature"][node], t["cut"][node], t["threshold"][node], t["lower"][node], t["upper"][node] = f, cut, self.edges[f][cut], lower, upper
        for node, s in self.sums.items():
            g, h = s[0][: self.first[1]].sum(), s[1][: self.first[1]].sum()
            t["value"][node] = -step * g / h if h > 0 else 0.0
        return t


def bin_edges(train: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Each feature's upper bin edges: its values, where they are few, else quantiles within a thousandth. The last bin is open."""
    quantiles = train.approxQuantile(features, [i / BINS for i in range(BINS + 1)], 0.001)
    return [np.append(np.unique(q)[:-1], np.inf) if q else np.array([np.inf]) for q in quantiles]


def boosted(train: DataFrame, features: list[str], label: str = "label", weight: str = "weight", rounds: int = 200, step: float = 0.05, leaves: int = 31, least_rows: int = 5) -> Boosted:
    """Boosted trees on the logistic loss, starting from the weighted share of label 1. Features must not be null; no rows or one label: no trees."""
    sums = train.agg(F.sum(F.col(weight)).alias("n"), F.sum(F.when(F.col(label) == 1, F.col(weight))).alias("p"), F.count("*").alias("rows")).first()
    if not sums.rows or not sums.p or sums.p >= sums.n:
        return Boosted(0.0 if not sums.rows else 30.0 if sums.p else -30.0)
    model = Boosted(float(np.log(sums.p / (sums.n - sums.p))))
    layout = Layout(bin_edges(train, features))
    sc = train.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(train.sparkSession, "boosting"))
    columns = [F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), *[F.col(f).cast("double") for f in features]]
    parts, start, shared = parts_of(sums.rows, sc.defaultParallelism), model.start, sc.broadcast(layout)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                y, w, *x = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, PIECE_ROWS).columns)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (shared.value.codes(x), y, w)], names=["codes", "y", "w"])

    def blocks(pieces: Iterator) -> Iterator[Block]:
        found = list(pieces)  # a partition's rows at most, of two bytes a group
        if found:
            y, w = (np.concatenate([np.frombuffer(p[i]) for p in found]) for i in (1, 2))
            codes = [np.frombuffer(p[0], np.uint16).reshape(len(shared.value.groups), -1) for p in found]
            yield Block(np.concatenate(codes, axis=1), y, w, np.full(len(y), start))

    # Rows are binned where they are; only pieces of codes are dealt.
    together = sums.rows <= ROWS_A_TASK
    held = train.select(*columns).mapInArrow(binned, "codes binary, y binary, w binary").repartition(1 if together else parts).rdd.mapPartitions(blocks)
    if together:
        model.trees = held.mapPartitions(lambda b: [_grown(Gathered(list(b), shared.value), shared.value, rounds, step, leaves, least_rows)]).collect()[0]
    else:
        spread = Spread(held.persist(StorageLevel.MEMORY_AND_DISK), layout)
        model.trees = _grown(spread, layout, rounds, step, leaves, least_rows)
        spread.blocks.unpersist()
    return model


def parts_of(rows: int, cores: int) -> int:
    """Partitions of the rows: one that fits one task, else as many as the cores, or more."""
    parts = -(-rows // ROWS_A_PART)
    return parts if parts == 1 else max(parts, min(cores, -(-rows // LEAST_ROWS_A_PART)))


def _grown(data: Gathered | Spread, layout: Layout, rounds: int, step: float, leaves: int, least_rows: int) -> list[dict[str, np.ndarray]]:
    """Tree after tree, until nothing gains any more."""
    trees = []
    for _ in range(rounds):
        growing = Growing(layout.edges, layout.first, leaves, least_rows, data.sums(_ROOT, [0])[0])
        while nodes := growing.wanted(data.at_once):
            small = growing.split(nodes)
            growing.measured(nodes, data.sums(growing.tree(0.0), small))
        if not growing.made:
            break
        trees.append(growing.tree(step, set(growing.made)))
        data.add(trees[-1])
    return trees


_ROOT = {"feature": np.array([-1]), "cut": np.array([0]), "lower": np.array([-1]), "upper": np.array([-1])}

