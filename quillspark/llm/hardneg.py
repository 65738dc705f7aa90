"""Hard-negative mining: exact integer scores of anchors against all rows by the method of the Four Russians."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored
from .nearest import Best, first_ranks, query_blocks, read_appended
from .topk import grid

#: Anchors of a broadcast block: at most so many, and so many components; a component takes 128 or 256 bytes of subset sums in a task.
ANCHORS_A_BLOCK, COMPONENTS_A_BLOCK = 4096, 1 << 18
#: Anchors whose tables are used together (they should stay in a core's cache), and scores of a slice.
ANCHORS_AT_ONCE, SCORES_A_SLICE = 512, 1 << 18


def bit_planes(v: np.ndarray) -> list[bytes]:
    """Each row's components in two's complement: for each bit, from the lowest, a byte for every eight dimensions. The
    last plane is the sign's; rows of small components have few planes."""
    n, d = v.shape
    groups = -(-d // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :d] = v
    largest = np.maximum(v, ~v).max(axis=1, initial=0)
    bits = 1 + ((largest[:, None] >> np.arange(63)) > 0).sum(axis=1)
    planes = np.empty((n, int(bits.max(initial=1)), groups), np.uint8)
    for p in range(planes.shape[1]):
        planes[:, p] = np.packbits(((wide >> p) & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0]
    return [planes[i, :b].tobytes() for i, b in enumerate(bits.tolist())]


class SubsetSums:
    """For every eight dimensions the sums of each anchor's components over all 256 subsets of them."""

    def __init__(self, vectors: np.ndarray):
        n, d = vectors.shape
        self.groups = -(-d // 8)
        wide = np.zeros((n, self.groups * 8), np.int64)
        wide[:, :d] = vectors
        self.largest = int(np.abs(wide).sum(axis=1, dtype=np.float64).max(initial=0)) + 1
        parts = wide.T.reshape(self.groups, 8, n)
        self.sums = np.zeros((self.groups, 256, n), np.int64)
        for j in range(8):
            self.sums[:, 1 << j : 2 << j] = self.sums[:, : 1 << j] + parts[:, j, None, :]
        self.narrow = self.sums.astype(np.int32) if self.largest < 1 << 31 else None

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """Inner products of candidates (rows), given as (rows, planes, groups) bytes, with all anchors (columns): from the sign's
        plane down the sum so far is doubled, and each plane's bytes are looked up and added."""
        n, bits, _ = planes.shape
        sums = self.narrow if self.narrow is not None and self.largest << bits < 1 << 31 else self.sums
        total, found = np.zeros((n, sums.shape[2]), sums.dtype), np.empty((n, sums.shape[2]), sums.dtype)
        for p in range(bits - 1, -1, -1):
            total += total
            for g in range(self.groups):
                np.take(sums[g], planes[:, p, g], axis=0, out=found, mode="clip")
                if p == bits - 1:
                    total -= found
                else:
                    total += found
        return total.astype(np.int64)


@dataclass
class Anchors:
    """A block of anchors; on the second scan with each one's positives' score ranges (lowest above highest: none)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, candidates' ids, their labels, scores with a row for each anchor)."""
        parts = [slice(at, min(at + ANCHORS_AT_ONCE, len(self.ids))) for at in range(0, len(self.ids), ANCHORS_AT_ONCE)]
        tables = [SubsetSums(self.vectors[p]) for p in parts]
        groups = max(1, tables[0].groups)
        step = max(1, SCORES_A_SLICE // ANCHORS_AT_ONCE)
        for batch in batches:
            ids, labels, planes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            sizes = np.array([len(x) for x in planes.to_pylist()], np.int64) // groups
            for bits in np.unique(sizes):
                at = np.flatnonzero(sizes == bits)
                for i in range(0, len(at), step):
                    some = at[i : i + step]
                    packed = np.frombuffer(b"".join(planes.take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), int(bits), -1)
                    for part, table in zip(parts, tables, strict=True):
                        yield part, ids[some], labels[some], table.scores(packed).T

    def positives(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {at: Best(min(ANCHORS_AT_ONCE, len(self.ids) - at), k) for at in range(0, len(self.ids), ANCHORS_AT_ONCE)}
            for part, ids, labels, scores in self.slices(batches):
                best[part.start].add(scores, ids, (self.labels[part, None] == labels[None, :]) & (self.ids[part, None] != ids[None, :]))
            for at, b in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[at + b.query]), pa.array(b.ids), pa.array(b.scores)], names=["anchor_id", "vec_id", "score"])

        return run

    def negatives(self, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {(at, r): Best(min(ANCHORS_AT_ONCE, len(self.ids) - at), k) for at in range(0, len(self.ids), ANCHORS_AT_ONCE) for r in range(self.low.shape[1])}
            for part, ids, labels, scores in self.slices(batches):
                other = (self.labels[part, None] != labels[None, :]) & (self.ids[part, None] != ids[None, :])
                for r in range(self.low.shape[1]):
                    best[part.start, r].add(scores, ids, other & (scores >= self.low[part, r, None]) & (scores <= self.high[part, r, None]))
            for (at, r), b in best.items():
                place = pa.array(np.full(len(b.ids), r, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[at + b.query]), place, pa.array(b.ids), pa.array(b.scores)], names=["anchor_id", "place", "vec_id", "score"])

        return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):  # nearly always one
            part = batch.filter(pa.array(dims == dim))
            v = part.column("v").flatten().to_numpy().reshape(part.num_rows, dim)
            rows = [part.column("vec_id"), part.column("label"), pa.array(bit_planes(v), pa.binary()), part.column("dim")]
            yield pa.RecordBatch.from_arrays(rows, names=["vec_id", "label", "planes", "dim"])


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor: for each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    other labels whose score is ``least`` to ``most`` hundredths of the positive's.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. A score is the inner product of
    floor(scale * x) vectors; higher ones come first, ties by smaller ids. Rows are packed once as bit planes and stored. Blocks of
    anchors of bounded size are broadcast to two scans of the rows, which are never shuffled: a task makes subset-sum tables of the
    anchors, looks rows' bytes up, and returns its first rows of each anchor (and of each positive's range, on the second scan).

    Rows with a null id or label, a null vector, or null or non-finite components take no part. Vectors of other lengths
    than the anchor's aren't its rows. Rows with the anchor's id are its own and never returned. A
    repeated anchor id is asked once, with its smallest (label, vector); other repeated rows each count. A positive below
    zero has no range, so no negatives; a positive that occurs twice (a repeated row) counts twice among the positives and its negatives are returned
    once. Sums and components beyond 64 bits wrap and saturate.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), grid(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").withColumn("dim", F.size("v"))
    packed = stored(rows.select("vec_id", "label", "v", "dim").mapInArrow(_packed, "vec_id long, label long, planes binary, dim int"), "hardneg-planes", "dim")
    anchors = stored(rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("x")).select("vec_id", "x.*"), "hardneg-anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path, written = new_path(spark, "hardneg-found"), False
    # A row per vector length; lengths without anchors are never scanned.
    for dim, n in sorted((r[0], r[1]) for r in anchors.groupBy("dim").agg(F.count("*")).collect()):
        candidates = packed.where(F.col("dim") == dim).select("vec_id", "label", "planes")
        for block in query_blocks(anchors.where(F.col("dim") == dim), dim, n, ANCHORS_A_BLOCK, COMPONENTS_A_BLOCK):
            asked = sorted(block.select("vec_id", "label", "v").collect())
            if asked:
                held = Anchors(np.array([r[0] for r in asked]), np.array([r[1] for r in asked]), np.array([r[2] for r in asked], np.int64).reshape(len(asked), dim))
                _block(candidates, held, positives, negatives, least, most).write.mode("append").parquet(path)
                written = True
    return read_appended(spark, schema, path, written)


def _block(candidates: DataFrame, held: Anchors, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """Hard negatives of a block of anchors."""
    sc = candidates.sparkSession.sparkContext
    shared = sc.broadcast(held)
    found = candidates.mapInArrow(lambda batches: shared.value.positives(positives)(batches), "anchor_id long, vec_id long, score long")
    first = sorted(first_ranks(found, positives, "anchor_id").select("anchor_id", "rank", "vec_id", "score").collect())  # a few rows for each anchor of the block
    at = {int(i): j for j, i in enumerate(held.ids)}
    low, high = np.full((len(held.ids), positives), 1, np.int64), np.zeros((len(held.ids), positives), np.int64)
    of, seen = [], set()
    for anchor, rank, positive, score in first:
        if (anchor, positive, score) in seen:
            continue
        seen.add((anchor, positive, score))
        of.append((anchor, rank - 1, positive, score))
        if score >= 0:
            low[at[anchor], rank - 1], high[at[anchor], rank - 1] = -(-least * score // 100), most * score // 100
    ranged = sc.broadcast(Anchors(held.ids, held.labels, held.vectors, low, high))
    found = candidates.mapInArrow(lambda batches: ranged.value.negatives(negatives)(batches), "anchor_id long, place int, vec_id long, score long")
    kept = candidates.sparkSession.createDataFrame(of, "anchor_id long, place int, positive_id long, positive_score long")
    ranked = first_ranks(found, negatives, "anchor_id", "place").join(F.broadcast(kept), ["anchor_id", "place"])  # a block's positives
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
