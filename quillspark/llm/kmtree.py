"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, stored
from .nearest import Best, finite, first_ranks, read_appended

#: The tree is fitted on at most so many rows and components, those of the smallest id hashes.
SAMPLE_ROWS, SAMPLE_COMPONENTS = 1 << 15, 1 << 22
#: Children of a node, sampled rows of a leaf that isn't split any more, and Lloyd's rounds of a node.
BRANCHES, LEAF_ROWS, ROUNDS = 16, 32, 8
#: Queries that calibrate the visits, those of the smallest id hashes.
CALIBRATION_QUERIES = 256
#: Components of a cell of the index, and queries that meet it at once.
COMPONENTS_A_CELL, QUERIES_AT_ONCE = 1 << 18, 128
#: Query rows of one vector are asked under so many keys, so that a hot vector's queries aren't one group.
SALTS = 64


@dataclass
class Tree:
    """Nodes in the order of their making, the root first; a node's children stand together.

    Inner products become distances: vectors (divided by ``unit``, the largest norm) get one more component, so that all have norm 1,
    and queries a zero there. Then the nearest is the one of the largest product.
    """

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    unit: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lifted(self, v: np.ndarray) -> np.ndarray:
        v = v / self.unit
        return np.column_stack([v, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", v, v)))])

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root to the nearest child, level by level."""
        x, at = self.lifted(v), np.zeros(len(v), np.int64)
        open_ = np.flatnonzero(self.count[at] > 0)
        while len(open_):
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                c = self.centres[self.first[node] : self.first[node] + self.count[node]]
                at[rows] = self.first[node] + ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(axis=1)
            open_ = open_[self.count[at[open_]] > 0]
        return self.leaf[at]

    def visits(self, queries: np.ndarray, most: int, size: np.ndarray, rows: int) -> list[list[int]]:
        """The first leaves of each query, best bin first: the nearest node that was seen and not taken yet is next, from any branch.
        Queries go on beyond so many leaves until these hold so many rows."""
        far = ((self.centres * self.centres).sum(1) - 2 * (queries / self.unit) @ self.centres[:, :-1].T).tolist()
        first, count, leaf, held = self.first.tolist(), self.count.tolist(), self.leaf.tolist(), size.tolist()
        found = []
        for d in far:
            heap, seen, total = [(d[0], 0)], [], 0
            while heap and (len(seen) < most or total < rows):
                node = heapq.heappop(heap)[1]
                if count[node]:
                    for child in range(first[node], first[node] + count[node]):
                        heapq.heappush(heap, (d[child], child))
                else:
                    seen.append(leaf[node])
                    total += held[leaf[node]]
            found.append(seen)
        return found


def fit(sample: np.ndarray, unit: float, seed: int = 0) -> Tree:
    """A tree over the sample: nodes of over LEAF_ROWS rows are split by k-means into at most BRANCHES, as long as that parts them."""
    tree = Tree(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), unit)
    x, rng = tree.lifted(sample), np.random.default_rng(seed)
    centres, first, count, todo = [x.mean(axis=0)], [0], [0], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            continue
        own = x[rows]
        c = own[rng.choice(len(rows), min(BRANCHES, -(-len(rows) // LEAF_ROWS)), replace=False)]
        for _ in range(ROUNDS):
            near = ((c * c).sum(1) - 2 * own @ c.T).argmin(axis=1)
            size = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, own)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        near = ((c * c).sum(1) - 2 * own @ c.T).argmin(axis=1)
        used = np.unique(near)
        if len(used) > 1:
            first[node], count[node] = len(centres), len(used)
            for j in used:
                todo.append((len(centres), rows[near == j]))
                centres.append(c[j])
                first.append(0)
                count.append(0)
    count = np.array(count)
    leaf = np.where(count == 0, np.cumsum(count == 0) - 1, -1)
    return Tree(np.array(centres), np.array(first), count, leaf, unit)


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, dim)


def ann(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """The k rows of the largest inner product with each query, other than its own, that the visited leaves hold.

    Returns query_id, rank (from 1), vec_id, score (the double-precision product of the original vectors), nearest first, ties by smaller
    ids. The tree is fitted on a sample of at most SAMPLE_ROWS rows; every row is put into its leaf. For CALIBRATION_QUERIES queries all
    rows are scored, and the number of leaves to visit is widened until the visited ones hold ``recall`` of their true neighbours; ``report`` gets
    (vector length, leaves, visits, recall there). Leaves are dealt to cells of bounded size, large leaves to several; a query is sent
    to the cells of its leaves, where candidates are held and queries stream by.

    Vectors that are null, zero or hold null or non-finite components take no part, null ids neither. Vectors of other lengths than the query's
    aren't candidates. Rows with the query's id are its own; a repeated query id is asked once, with its smallest vector. Rows alike in id and
    vector count once. Of rows alike in vector only the k + 1 smallest ids can be among the first k, so the others aren't
    indexed beside them; queries alike in vector are searched together, but for ids with several vectors. Visits go on until k others are found; fewer than k
    candidates: all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"), (F.min("v") != F.max("v")).alias("several"))
    alike = Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)), F.when(F.col("several"), F.col("vec_id")))
    asked = stored(asked.withColumns({"class": F.min("vec_id").over(alike), "alone": F.count("*").over(alike) == 1, "dim": F.size("v")}), "ann-queries", "dim")
    schema = "class long, vec_id long, score double"
    path, written = new_path(spark, "ann-found"), False
    # A row per vector length; lengths without queries are never indexed.
    for (dim,) in sorted(asked.select("dim").distinct().collect()):
        held = rows.where(F.col("dim") == dim).select("vec_id", "v")
        queries = asked.where((F.col("dim") == dim) & (F.col("class") == F.col("vec_id"))).select("vec_id", "v", "alone")
        tree = _fitted(held, dim)
        shared = spark.sparkContext.broadcast(tree)
        copies = Window.partitionBy("v").orderBy("vec_id")
        one = held.select("vec_id", "v", F.dense_rank().over(copies).alias("place"), F.lag("vec_id").over(copies).alias("before"))
        one = one.where((F.col("place") <= k + 1) & ~F.col("vec_id").eqNullSafe(F.col("before"))).select("vec_id", "v")
        index = stored(one.mapInArrow(_indexed(shared, dim), f"vec_id long, v {held.schema['v'].dataType.simpleString()}, leaf int"), "ann-index")
        visits, reached = calibrated(index, queries, tree, dim, k, recall)
        if report is not None:
            report.append((dim, tree.leaves, visits, reached))
        _searched(index, queries, shared, dim, k + 1, visits).write.mode("append").parquet(path)
        written = True
    found = read_appended(spark, schema, path, written)
    best = found.groupBy("class").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k + 1).alias("best"))  # k + 1 of each visited cell
    own = asked.select(F.col("vec_id").alias("query_id"), "class").join(best, "class")
    others = own.select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))


def _fitted(held: DataFrame, dim: int) -> Tree:
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch, "v", dim)
                largest = np.abs(v).max(axis=1)
                most = max(most, float((largest * np.sqrt(((v / largest[:, None]) ** 2).sum(axis=1))).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], names=["norm"])

    unit = held.select("v").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    sample = held.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS // dim))).select("v").toArrow()
    return fit(np.concatenate([_matrix(b, "v", dim) for b in sample.to_batches()]), unit)


def _indexed(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_matrix(batch, "v", dim))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "leaf"])

    return run


def calibrated(index: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> tuple[int, float]:
    """The fewest leaves that hold this share of the true k neighbours of some queries, found by brute force over all rows, and their share."""
    spark = index.sparkSession
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION_QUERIES).toArrow().combine_chunks().to_batches()[0]
    ids, q = some.column("vec_id").to_numpy(), _matrix(some, "v", dim)
    shared = spark.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = Best(len(ids), k, np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                others, leaf = part.column("vec_id").to_numpy(), part.column("leaf").to_numpy().astype(np.int64)
                best.add(q @ _matrix(part, "v", dim).T, others, ids[:, None] != others[None, :], leaf)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.ids), pa.array(best.notes), pa.array(best.scores)], names=["query", "vec_id", "leaf", "score"])

    true = first_ranks(index.mapInArrow(run, "query long, vec_id long, leaf long, score double"), k, "query").select("query", "leaf").collect()  # k for each of these queries
    if not true:
        return 1, 1.0
    order = np.array(tree.visits(q, tree.leaves, np.zeros(tree.leaves), 0))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(tree.leaves)[None, :], axis=1)
    places = np.array([place[a, b] for a, b in true])
    visits = 1
    while (places < visits).mean() < recall:
        visits += 1
    return visits, float((places < visits).mean())


def _searched(index: DataFrame, queries: DataFrame, shared, dim: int, k: int, visits: int) -> DataFrame:
    """The k first rows of each query in each cell that it visits: class, vec_id, score."""
    spark, tree = index.sparkSession, shared.value
    size = np.zeros(tree.leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # a row for each leaf of the tree, whose size is bounded
        size[leaf] = n
    most = max(1, COMPONENTS_A_CELL // dim)
    parts = np.maximum(1, -(-size // most))
    cell, first, room = -1, np.zeros(tree.leaves, np.int64), 0
    for leaf in np.argsort(tree.leaf[tree.leaf >= 0], kind="stable"):
        if parts[leaf] > 1 or size[leaf] > room:
            cell, room = cell + 1, most
        first[leaf] = cell
        if parts[leaf] > 1:
            cell, room = cell + int(parts[leaf]) - 1, 0
        room -= min(room, int(size[leaf]))
    plan = spark.sparkContext.broadcast((first, parts, size))
    names = ["cell", "asks", "vec_id", "v", "leaves", "alone"]

    def rows_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, _ = plan.value
        for batch in batches:
            leaf, ids = batch.column("leaf").to_numpy().astype(np.int64), batch.column("vec_id").to_numpy()
            cells = first[leaf] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[leaf]
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32)), batch.column("leaf"))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.zeros(batch.num_rows, bool)), batch.column("vec_id"), batch.column("v"), leaves, pa.array(np.zeros(batch.num_rows, bool))], names=names)

    def queries_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, size = plan.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows, cells, leaves = [], [], []
                for i, seen in enumerate(shared.value.visits(_matrix(batch, "v", dim), visits, size, k)):
                    by_cell: dict[int, list[int]] = {}
                    for leaf in seen:
                        for c in range(first[leaf], first[leaf] + parts[leaf]):
                            by_cell.setdefault(c, []).append(leaf)
                    for c, found in by_cell.items():
                        rows.append(i)
                        cells.append(c)
                        leaves.append(found)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.ones(len(rows), bool)), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(leaves, pa.list_(pa.int32())), batch.column("alone").take(take)], names=names)

    schema = f"cell long, asks boolean, vec_id long, v {index.schema['v'].dataType.simpleString()}, leaves array<int>, alone boolean"
    tasks = max(spark.sparkContext.defaultParallelism, queries.rdd.getNumPartitions())  # a traversal takes much longer than reading a query
    met = index.mapInArrow(rows_out, schema).unionByName(queries.repartition(tasks, "vec_id").mapInArrow(queries_out, schema))
    met = met.repartition("cell").sortWithinPartitions("cell", "asks")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Cell(dim, k)
        for batch in batches:
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                run = batch.slice(start, stop - start)
                if not run.num_rows:
                    continue
                if not asks[start]:
                    held.hold(int(cells[start]), run)
                elif int(cells[start]) == held.cell:
                    yield from held.asked(run)

    return met.mapInArrow(meet, "class long, vec_id long, score double")


class Cell:
    """The candidates of one cell, which queries pass."""

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.cell, self.parts, self.sorted = dim, k, None, [], None

    def hold(self, cell: int, run: pa.RecordBatch) -> None:
        if cell != self.cell:
            self.cell, self.parts, self.sorted = cell, [], None
        self.parts.append((run.column("vec_id").to_numpy(), _matrix(run, "v", self.dim), run.column("leaves").flatten().to_numpy()))

    def asked(self, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The k first candidates of each query among those of the leaves that it visits."""
        if self.sorted is None:
            ids, v, leaf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((ids, leaf))
            leaf = leaf[order]
            leaves = np.unique(leaf)
            self.sorted = ids[order], v[order], {int(x): (a, b) for x, a, b in zip(leaves, np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right"), strict=True)}
            self.parts = []
        ids, v, where = self.sorted
        norm = float(np.sqrt((v * v).sum(1).max(initial=0)))
        for at in range(0, run.num_rows, QUERIES_AT_ONCE):
            part = run.slice(at, QUERIES_AT_ONCE)
            q, asked = _matrix(part, "v", self.dim), part.column("vec_id").to_numpy()
            scores = np.full((len(q), len(ids)), -np.inf)
            by_leaf: dict[int, list[int]] = {}
            for i, leaves in enumerate(part.column("leaves").to_pylist()):
                for leaf in leaves:
                    by_leaf.setdefault(leaf, []).append(i)
            for leaf, who in by_leaf.items():
                if leaf in where:
                    a, b = where[leaf]
                    scores[who, a:b] = q[who] @ v[a:b].T
            scores[part.column("alone").to_numpy(zero_copy_only=False)[:, None] & (asked[:, None] == ids[None, :])] = -np.inf
            least = np.full(len(q), -np.inf)
            if len(ids) > self.k:  # a little below the kth: a product's last digits depend on where in a matrix it stands
                least = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 1e-9 * norm * np.sqrt((q * q).sum(1))
            i, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            exact = (q[i] * v[c]).sum(axis=1)
            order = np.lexsort((ids[c], -exact, i))
            i, c, exact = i[order], c[order], exact[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
            yield pa.RecordBatch.from_arrays([pa.array(asked[i[keep]]), pa.array(ids[c[keep]]), pa.array(exact[keep])], names=["class", "vec_id", "score"])


def measured_recall(found: DataFrame, vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of the true k neighbours among those found, by brute force: for tests and small tables only."""
    rows = vectors.where(finite(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q")).toArrow().to_pandas()
    v = np.vstack(rows["v"].to_numpy()).astype(np.float64)
    ids, got = rows["vec_id"].to_numpy(), {}
    for query, other in found.select("query_id", "vec_id").collect():
        got.setdefault(query, set()).add(other)
    hit = total = 0
    for query, x in zip(ids[rows["q"]], v[rows["q"]], strict=True):
        score = v @ x
        order = [i for i in np.lexsort((ids, -score))[: k + 1] if ids[i] != query][:k]
        hit += sum(int(ids[i]) in got.get(query, ()) for i in order)
        total += len(order)
    return hit / max(1, total)
