"""Streams over several micro-batches: restarts, late and repeated input, expiry, published thresholds."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspark.operators import forecast, review
from quillspark.sources.ledger import sales_ledger
from quillspark.sources.tables import KeyedTable
from quillspark.streaming import jobs
from quillspark.streaming.run import ran, with_rocksdb

from .conftest import SF


def files(spark, path, parts, schema):
    """A stream with a micro-batch for each part, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


UPLOADS = "id long, uploaded_at timestamp, confidence_score double"


def uploads(*days):
    return [(k, __import__("datetime").datetime(2024, 1, d, 12), 0.5) for k, d in enumerate(days)]


def test_late_uploads_are_dropped_and_days_updated(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [uploads(3, 3, 4), uploads(4, 20), uploads(20), uploads(3, 20)], UPLOADS)
    path = f"file://{tmp_path}/out"
    got = {r.day: r.documents for r in ran(jobs.throughput(stream), "update", ["day"], path).collect()}
    assert got == {"2024-01-03": 2, "2024-01-04": 2, "2024-01-20": 3}  # the third of January that came two micro-batches after the twentieth is late
    spark.createDataFrame(uploads(21, 20), UPLOADS).coalesce(1).write.parquet(f"{tmp_path}/in/900")
    got = {r.day: r.documents for r in ran(jobs.throughput(stream), "update", ["day"], path).collect()}  # a restart
    assert got == {"2024-01-03": 2, "2024-01-04": 2, "2024-01-20": 4, "2024-01-21": 1}


def test_drift_takes_late_documents_of_open_days(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [uploads(3), uploads(4), uploads(3)], UPLOADS).withColumn("conf", F.col("confidence_score"))
    got = {r.day: (r.avg_confidence, r.documents) for r in ran(jobs.confidence_drift(stream, "3 days"), "update", ["day"], f"file://{tmp_path}/out").collect()}
    assert got == {"2024-01-03": (0.5, 2), "2024-01-04": (0.5, 1)}


def test_table_keeps_a_batch_once_and_rows_whole(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v long", ["k"], 4)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    seen = lambda: {(r.k, r.v) for r in t.read().collect()}
    assert seen() == set()
    assert t.upsert(rows(("a", 1), (None, 2), ("b", 3)), "s", 0)
    assert t.upsert(rows(("b", 4), ("c", 5)), "s", 1)
    assert not t.upsert(rows(("b", 9)), "s", 1) and not t.upsert(rows(("b", 9)), "s", 0)  # given again
    assert seen() == {("a", 1), (None, 2), ("b", 4), ("c", 5)}
    before = t.read()
    assert t.upsert(rows((None, 6)))
    assert {(r.k, r.v) for r in before.collect()} == {("a", 1), (None, 2), ("b", 4), ("c", 5)}  # readers of the old version keep it
    bad = rows(("a", 7)).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):
        t.upsert(bad)
    assert seen() == {("a", 1), (None, 6), ("b", 4), ("c", 5)}
    assert t.upsert(rows()) and len(seen()) == 4
    version = t.manifest()[0]
    t.upsert(rows(("z", 1)))
    with pytest.raises(Exception):  # two writers of one version
        rows().write.mode("error").parquet(f"file://{tmp_path}/t/manifest/v{version + 1}")


def test_table_replaces_all_rows_of_a_document(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "d string, k string, v long", ["d", "k"], 4)
    rows = lambda *r: spark.createDataFrame(list(r), "d string, k string, v long")
    t.upsert(rows(("x", "a", 1), ("x", "b", 2), ("y", "a", 3), (None, "a", 4)))
    t.replace(rows(("x", "c", 5), (None, "b", 6)), ["d"])
    assert {tuple(r) for r in t.read().collect()} == {("x", "c", 5), ("y", "a", 3), (None, "b", 6)}


LOG = "key long, ts timestamp, seq long, status string"


def log():
    import datetime as dt

    states = list(review.TRANSITIONS)
    return [(k % 7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), k, states[(k * k + k // 7) % len(states)]) for k in range(210)]


def test_transitions_equal_the_batch_form_with_a_restart(spark, tmp_path):
    rows = log()
    stream, out = files(spark, tmp_path / "in", [rows[:60], rows[60:90]], LOG), f"file://{tmp_path}/out"
    ran(jobs.invalid_transitions(stream), "append", path=out)
    for k, part in enumerate((rows[90:200], rows[200:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/9{k}")
        time.sleep(0.01)
    got = sorted(tuple(r) for r in ran(jobs.invalid_transitions(stream), "append", path=out).collect())
    want = sorted(tuple(r) for r in review.invalid_transitions(spark.createDataFrame(rows, LOG)).select("key", "seq", "before", "status").collect())
    assert got == want and len(want) > 50


DOCS = "batch_id string, document_id string, status string, seq long"


def test_batches_end_once_and_ignore_what_comes_later(spark, tmp_path):
    parts = [
        [("a", "1", "processing", 1), ("a", "2", "uploaded", 1), ("b", "1", "failed", 5)],
        [("a", "1", "verified", 2), ("b", "2", "processing", 6), ("a", "2", "processing", 0)],
        [("a", "2", "failed", 3), ("c", "1", "processing", 1)],
        [("a", "2", "verified", 4), ("c", "1", "verified", 2)],
    ]
    stream = files(spark, tmp_path / "in", parts, DOCS)
    assert sorted(tuple(r) for r in ran(jobs.batch_progress(stream), "append", path=f"file://{tmp_path}/out").collect()) == [("a", "partial_failed"), ("b", "partial_failed"), ("c", "completed")]


def wait(done, seconds=40):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)


def test_silent_keys_are_forgotten(spark, tmp_path):
    """After its time a batch is new: what is known of its documents is gone."""
    stream = files(spark, tmp_path / "in", [[("a", "1", "processing", 1)]], DOCS)
    start = jobs.batch_progress(stream, kept_ms=1).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(processingTime="200 milliseconds").start
    query = with_rocksdb(spark, start)
    ended = lambda n: wait(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= n)
    try:
        ended(1)
        time.sleep(2)
        spark.createDataFrame([("a", "2", "verified", 2)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in/900")
        ended(2)
    finally:
        query.stop()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", "completed")]


def test_recalibration_publishes_what_the_batch_form_fits(spark, tmp_path):
    ap = sales_ledger(spark, SF)
    corrections = ap.corrections.orderBy("id").limit(300).toPandas()
    loop = jobs.Recalibration(ap, f"file://{tmp_path}/loop", 10)
    at = [0, 4, 8, 120, 300]
    for k in range(4):
        part = spark.createDataFrame(corrections[at[k] : at[k + 1]], ap.corrections.schema)
        jobs.Recalibration(ap, f"file://{tmp_path}/loop", 10)(part, k)  # a restart each time
        loop(part, k)  # and the batch given again
        assert loop.corrections() == at[k + 1] and loop.published() == (at[k + 1] if at[k + 1] >= 10 else 0)
    want = {(r.field_name, r.samples, r.threshold) for r in forecast.calibrate(replace(ap, corrections=spark.createDataFrame(corrections, ap.corrections.schema))).collect()}
    assert {(r.field_name, r.samples, r.threshold) for r in loop.thresholds.read().collect()} == want and len(want) > 3
    queue = review.review_queue(ap, loop.thresholds.read().select("field_name", "threshold"))
    assert queue.where("review").count() > 0


def test_state_is_asked_no_more_than_needed():
    """A batch that ends at once reads no map and writes no document; one that runs writes each document once."""
    import pandas as pd

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (False if name in ("exists", "containsKey") else None)

    progress = jobs._Progress(None)
    progress.documents, progress.counts, progress.handle = State(), State(), None
    rows = lambda *r: [pd.DataFrame(r, columns=["document_id", "status", "seq"])]
    done = list(progress.handleInputRows(("a",), iter(rows(("1", "processing", 1), ("1", "verified", 2), ("2", "failed", 1), ("2", "uploaded", 0))), None))
    assert [tuple(r) for r in done[0].values] == [("a", "partial_failed")] and calls == ["exists", "update"]
    calls.clear()
    assert list(progress.handleInputRows(("b",), iter(rows(("1", "uploaded", 1), ("1", "processing", 2), ("2", "failed", 1))), None))[0].empty
    assert calls == ["exists", "updateValue", "updateValue", "update"]
