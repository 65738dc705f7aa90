"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Queries of a broadcast block: at most so many, and about so many vector components (8 bytes each).
QUERIES_A_BLOCK, COMPONENTS_A_BLOCK = 4096, 1 << 20
#: Scores of a block and a slice of candidates: about so many at once (8 bytes each, with a few arrays of this size beside them).
SCORES_A_SLICE = 1 << 20
BINS = 1024


def grid(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a long; null for vectors that are null or hold null or non-finite ones."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


@dataclass
class Block:
    """Queries of one vector length: ids, vectors (rows), and per pass their ranges and widths, or their kth values."""

    ids: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    width: np.ndarray

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Integer inner products of all queries (rows) and candidates (columns)."""
        most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
        if most(self.vectors) * most(v) * max(1, v.shape[1]) < 2**53:  # doubles are exact so far, and much faster
            return (self.vectors.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
        return self.vectors @ v.T

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of candidates of this length; a query's own rows are marked by the id."""
        step = max(1, SCORES_A_SLICE // len(self.ids))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
            for at in range(0, len(ids), step):
                yield ids[at : at + step], self.scores(v[at : at + step])

    def histogram(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Counts by bin of each query's range, from the top bin down to the one with a slice's kth score."""
            counts: dict[tuple[int, int], int] = {}
            for ids, s in self.slices(batches):
                at = np.minimum((s - self.lo[:, None]) // self.width[:, None], BINS - 1)
                at[(s < self.lo[:, None]) | (s >= self.hi[:, None]) | (self.ids[:, None] == ids[None, :])] = -1
                if at.shape[1] > k:  # lower bins can't hold the kth
                    at[at < np.partition(at, at.shape[1] - k, axis=1)[:, at.shape[1] - k][:, None]] = -1
                q, c = np.nonzero(at >= 0)
                cells, n = np.unique(q * BINS + at[q, c], return_counts=True)
                for cell, m in zip(cells.tolist(), n.tolist(), strict=True):
                    counts[cell] = counts.get(cell, 0) + m
                if len(counts) > 1 << 20:
                    yield _cells(self.ids, counts)
                    counts = {}
            yield _cells(self.ids, counts)

        return run

    def select(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Scores above the kth value (lo), and of those at it the k smallest ids of each slice."""
            for ids, s in self.slices(batches):
                order = np.argsort(ids, kind="stable")
                ids, s = ids[order], s[:, order]
                own = self.ids[:, None] == ids[None, :]
                ties = (s == self.lo[:, None]) & ~own
                pick = ((s > self.lo[:, None]) & ~own) | (ties & (np.cumsum(ties, axis=1) <= k))
                q, c = np.nonzero(pick)
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(ids[c]), pa.array(s[q, c])], names=["query_id", "vec_id", "score"])

        return run


def _cells(ids: np.ndarray, counts: dict[int, int]) -> pa.RecordBatch:
    cells = np.fromiter(counts, np.int64, len(counts))
    return pa.RecordBatch.from_arrays([pa.array(ids[cells // BINS]), pa.array(cells % BINS), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["query_id", "bin", "n"])


def _reached(bins: DataFrame, need: DataFrame) -> list:
    """Of each query the bin, from the top, where the scores still needed are reached (the lowest, if they aren't), with the scores above it and down to it."""
    w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    sums = bins.groupBy("query_id", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(w)).join(F.broadcast(need), "query_id")  # a block's queries
    first = F.struct((F.col("upto") < F.col("need")).alias("short"), F.when(F.col("upto") < F.col("need"), -F.col("upto")).otherwise(F.col("upto")).alias("by"))
    return sums.groupBy("query_id").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "upto"), first).alias("r")).select("query_id", "r.*").collect()


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query with every other row, ties to smaller ids.

    Returns query_id, rank (from 1), vec_id, score. Queries are dealt to blocks of bounded size; a block is broadcast to scans of the
    candidates, which are never shuffled. Each pass counts scores in 1,024 bins of each query's range, keeps the bin with
    the kth value as the next range, and ends when that range is one value. Then scores above the kth value,
    and the smallest ids at it, are kept and ranked; no slice keeps over k ties, since later ones can't win.

    Vectors null or with null or non-finite components take no part, ids that are null neither. Vectors
    of other lengths than the query's aren't candidates. Rows with the query's id are its own; a repeated
    query id is asked once, with its smallest vector; repeated candidates each count. Fewer than k
    candidates: all. Sums beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), grid(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    base = stored(base.withColumns({"dim": F.size("v"), "norm": norm}), "topk-vectors", "dim")
    queries = stored(base.where("q").groupBy("vec_id").agg(F.min_by(F.struct("dim", "norm", "v"), F.struct(F.col("v"))).alias("x")).select("vec_id", "x.*"), "topk-queries")
    schema = "query_id long, vec_id long, score long"
    found = None
    # A row per vector length and a few blocks each; lengths without queries are never scanned.
    for dim, n in sorted((r[0], r[1]) for r in queries.groupBy("dim").agg(F.count("*")).collect()):
        candidates = base.where(F.col("dim") == dim)
        widest_norm = candidates.agg(F.max("norm")).first()[0]
        blocks = -(-n // max(1, min(QUERIES_A_BLOCK, COMPONENTS_A_BLOCK // max(dim, 1))))
        for b in range(blocks):
            rows = sorted(queries.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v", "norm").collect())
            if rows:
                best = stored(_block_best(candidates, rows, dim, widest_norm, k, schema), "topk-best")
                found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))


def _block_best(candidates: DataFrame, rows: list, dim: int, widest_norm: float, k: int, schema: str) -> DataFrame:
    """Each query's scores above its kth value, and at least k at it, where there are so many."""
    spark = candidates.sparkSession
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    vectors = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dim)
    # |score| <= |q| * max |c| (Cauchy-Schwarz), a little more for rounding.
    bound = np.array([math.ceil(r[2] * widest_norm * 1.000001) + 1 for r in rows], dtype=np.int64)
    block = Block(ids, vectors, -bound, bound + 1, np.ones(len(ids), np.int64))
    scanned, need, at = candidates.select("vec_id", "v"), np.full(len(ids), k, np.int64), {int(i): j for j, i in enumerate(ids)}
    while (block.hi - block.lo).max() > 1:
        block.width = np.maximum(1, -(-(block.hi - block.lo) // BINS))
        shared = spark.sparkContext.broadcast(block)
        bins = scanned.mapInArrow(lambda batches: shared.value.histogram(k)(batches), "query_id long, bin long, n long")  # noqa: B023
        reached = _reached(bins, spark.createDataFrame(list(zip(ids.tolist(), need.tolist(), strict=True)), "query_id long, need long"))
        lo, hi = block.lo.copy(), block.lo + 1  # a query without any score keeps its lowest value
        for query, place, above, upto in reached:
            j = at[query]
            lo[j] = block.lo[j] + place * block.width[j]
            hi[j] = min(lo[j] + block.width[j], block.hi[j])
            need[j] = min(need[j], upto) - above
        block = Block(ids, vectors, lo, hi, block.width)
    shared = spark.sparkContext.broadcast(block)
    return scanned.mapInArrow(lambda batches: shared.value.select(k)(batches), schema)
