"""Label-value pairs: blocks are read, classified and dealt once; pages of one hash are kept apart."""

import random

import numpy as np
import pyarrow as pa

from quillspark.operators import layout

from .test_round3 import BLOCK, random_blocks


def test_blocks_are_dealt_once(spark, tmp_path):
    spark.createDataFrame(random_blocks(1), BLOCK).write.parquet(str(tmp_path / "b"))
    plan = layout.pair_labels(spark.read.schema(BLOCK).parquet(str(tmp_path / "b")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange") <= 2


def test_best_pairs_are_the_first_candidates(spark):
    df = spark.createDataFrame(random_blocks(5), BLOCK)
    rows = lambda x: sorted((tuple(r) for r in x.collect()), key=repr)
    assert rows(layout._paired(df, True)) == rows(layout.pair_candidates(df).where("rank = 1")) != []


def test_large_and_mixed_pages():
    """Pages that go over several batches, or share their hash, give the pairs of each page by itself."""

    def batch(rows):
        names = "document_id page pos code money value x1 y1 x2 y2 h".split()
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), *[pa.float64()] * 4, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rnd, rows = random.Random(2), []
    for doc, page, h in (("a", 1, 5), (None, None, 5), ("b", 1, 5), ("b", 2, 9)):
        for pos in range(60):
            x, y, label = rnd.uniform(0, 300), rnd.uniform(0, 300), pos % 3 == 0
            rows.append((doc, page, pos, rnd.choice([0, 5]) if label else -1, pos % 3 == 1, None if label else f"{doc}{pos}", x, y, x + 40, y + 10, h))
    got = lambda batches, best: sorted((tuple(r.values()) for b in layout._pairs(iter(batches), best) for r in b.to_pylist()), key=repr)
    mixed = [*rnd.sample(rows[:180], 180), *rows[180:]]
    for best in (True, False):
        apart = sorted((r for k in range(0, 240, 60) for r in got([batch(rows[k : k + 60])], best)), key=repr)
        assert got([batch(mixed[k : k + 7]) for k in range(0, 240, 7)], best) == apart and len(apart) > 30


def test_neighbours_in_pieces(monkeypatch):
    monkeypatch.setattr(layout, "_TOGETHER", 3)
    c, page = np.array([1.0, 2.0, 2.5, 9.0, 1.0, np.nan]), np.array([1, 1, 1, 1, 2, 2])
    values = np.array([0, 1, 2, 3, 4])
    got = {(int(a), int(v)) for x, y in layout._near(c, np.ones(6), page, np.arange(6), values) for a, v in zip(x, y, strict=True)}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)}
