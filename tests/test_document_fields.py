"""Fields of documents by layout and triangulated amounts in one pass (F15)."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from quillspark.operators import layout

from .test_round3 import BLOCK, random_blocks


def rows_of(seed, pages=True):
    """Pages in any order, some of them unknown."""
    return [(x[0], None if pages and x[1] == 1 and x[0] == "d1" else x[1], *x[2:]) for x in random.Random(seed).sample(random_blocks(seed, 120), 120)]


def test_claims_one_by_one(spark):
    df = spark.createDataFrame(rows_of(4), BLOCK).repartition(5)
    best = [r for r in layout.pair_candidates(df).where("rank = 1").collect()]
    want, taken = {}, set()
    for r in sorted(best, key=lambda r: (r.document_id, r.page is not None, r.page or 0, r.l_pos)):
        if (r.document_id, r.field_name) not in want and (r.document_id, r.page, r.v_pos) not in taken:
            want[r.document_id, r.field_name] = r.value
            if r.page is not None:
                taken.add((r.document_id, r.page, r.v_pos))
    assert {(r.document_id, r.field_name): r.value for r in layout.pair_labels(df).collect()} == want and len(want) > 8


def test_document_fields_are_pairs_and_triangles(spark):
    df = spark.createDataFrame(rows_of(7), BLOCK).repartition(3)
    got = {r.document_id: r for r in layout.document_fields(df, F.col("document_id") != "d2").collect()}
    pairs = {(r.document_id, r.field_name): r.value for r in layout.pair_labels(df.where("document_id <> 'd2'")).collect()}
    amounts = layout.classify_blocks(df).where("amount is not null").select("document_id", "pos", F.col("amount").alias("value"))
    found = {r.document_id: (r.total, r.subtotal, r.tax) for r in layout.triangulate(amounts).collect()}
    assert set(got) == {"d0", "d1", "d2"} and len(pairs) > 5
    for doc, r in got.items():
        assert {n: r[n] for n in layout.LABELS} == {n: pairs.get((doc, n)) for n in layout.LABELS}
        assert (r.found_total, r.found_subtotal, r.found_tax) == found.get(doc, (None,) * 3)
    assert layout.document_fields(df.limit(0)).count() == 0


def test_triangles_of_any_size(spark):
    """Amounts of a matrix, of many, beyond 64 bits and repeated ones: the first tax of several, and sums off by .02."""
    rows = [("few", 5, "3"), ("few", 2, "3.01"), ("few", 1, "7"), ("few", 0, "10.00"), ("few", 3, "-4"), ("few", 4, "0"), ("few", 6, "x")]
    rows += [("many", i, str(2**i)) for i in range(20)] + [("many", 20, f"{2**19 + 2**18}.02")]
    rows += [("wide", 0, str(10**31)), ("wide", 1, str(10**31 - 10**20)), ("wide", 2, str(10**20)), ("wide", 3, "5")]
    rows += [("none", 0, "1"), ("none", 1, "3"), ("none", 2, "10"), ("two", 0, "1"), ("two", 1, "2"), (None, 0, "1"), (None, 1, "2"), (None, 2, "3")]
    got = {r.document_id: (r.total, r.subtotal, r.tax) for r in layout.triangulate(spark.createDataFrame(rows, "document_id string, pos int, value string").repartition(4)).collect()}
    want = {"few": ("10", "7", "3.01"), "many": (f"{2**19 + 2**18}.02", str(2**19), str(2**18)), "wide": (str(10**31), str(10**31 - 10**20), str(10**20)), None: ("3", "2", "1")}
    assert got == {k: tuple(map(Decimal, v)) for k, v in want.items()}


def test_blocks_are_read_and_dealt_once(spark, tmp_path):
    spark.createDataFrame(random_blocks(1), BLOCK).write.parquet(str(tmp_path / "b"))
    b = spark.read.schema(BLOCK).parquet(str(tmp_path / "b"))
    for df in (layout.document_fields(b, F.col("pos") > 3), layout.pair_labels(b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Aggregate" not in plan
