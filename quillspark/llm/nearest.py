"""What the searches of stated queries against all rows share: valid vectors, blocks of queries, best rows of a task and of all."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def query_blocks(queries: DataFrame, dim: int, n: int, most: int, components: int) -> list[DataFrame]:
    """n queries of a vector length dealt by id to blocks of about so many queries and vector components."""
    blocks = -(-n // max(1, min(most, components // max(dim, 1))))
    return [queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) for b in range(blocks)]


class Best:
    """The k first (higher score, then smaller id) of each of n queries, over any number of slices of candidates."""

    def __init__(self, n: int, k: int, kind=np.int64):
        self.n, self.k = n, k
        self.low = np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.query, self.ids, self.notes, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self.floor = np.full(n, self.low, kind)

    def add(self, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray, notes: np.ndarray | None = None) -> None:
        """scores and ok of (queries, candidates): candidates where ok is true take part. A candidate's note is kept with it."""
        pick = ok & (scores >= self.floor[:, None])
        extra = scores.shape[1] - self.k
        if extra > 0 and np.count_nonzero(pick) > 2 * self.k * self.n:
            pick &= scores >= np.partition(np.where(pick, scores, self.low), extra, axis=1)[:, extra, None]
        q, c = np.nonzero(pick)
        if not len(q):
            return
        note = np.append(self.notes, np.zeros(len(c), np.int64) if notes is None else notes[c])
        query, id_, score = np.append(self.query, q), np.append(self.ids, ids[c]), np.append(self.scores, scores[q, c])
        order = np.lexsort((id_, -score, query))
        query, id_, note, score = query[order], id_[order], note[order], score[order]
        first = np.searchsorted(query, np.arange(self.n))
        keep = np.arange(len(query)) - first[query] < self.k
        self.query, self.ids, self.notes, self.scores = query[keep], id_[keep], note[keep], score[keep]
        size = np.bincount(self.query, minlength=self.n)
        full = np.flatnonzero(size == self.k)
        self.floor[full] = self.scores[np.cumsum(size)[full] - 1]


def first_ranks(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k first rows of each key by score (down) and vec_id, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def read_appended(spark: SparkSession, schema: str, path: str, written: bool) -> DataFrame:
    """The table that blocks were appended to; empty where there was no block."""
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
