"""Streams of documents, status events and corrections; each has the result of its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.forecast import fit_counts
from ..operators.review import TRANSITIONS
from ..sources.ledger import Ledger
from ..sources.shared import stored
from ..sources.tables import KeyedTable


def throughput(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads a day (uploaded_at), for update mode: a micro-batch gives the days that it changed. What comes later than the watermark
    allows is left out, and days before it leave the state."""
    days = stream.withWatermark("uploaded_at", late).groupBy(F.window("uploaded_at", "1 day"))
    return days.agg(F.count("*").alias("documents")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "documents")


def with_confidence(stream: DataFrame, fields: DataFrame) -> DataFrame:
    """stream of documents with conf: their own confidence, else the mean of their fields' (a static table)."""
    mean = fields.groupBy("document_id").agg(F.avg("confidence").alias("field_mean"))
    return stream.join(mean, F.col("id") == F.col("document_id"), "left").withColumn("conf", F.coalesce("confidence_score", "field_mean"))


def confidence_drift(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily mean of conf over documents that have it, for update mode as throughput."""
    days = stream.where("conf is not null").withWatermark("uploaded_at", late).groupBy(F.window("uploaded_at", "1 day"))
    return days.agg(F.round(F.avg(F.col("conf").cast("decimal(10,6)")), 3).cast("double").alias("avg_confidence"), F.count("*").alias("documents")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "avg_confidence", "documents")


class _Kept(StatefulProcessor):
    """State of a key that is forgotten when the key has been silent for kept_ms (null: never). One timer a key: each row moves it on."""

    def __init__(self, kept_ms: int | None):
        self.kept_ms = kept_ms

    def _again(self, handle: StatefulProcessorHandle, timers) -> None:
        if self.kept_ms is not None:
            for t in list(handle.listTimers()):
                handle.deleteTimer(t)
            handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.kept_ms)

    def close(self) -> None:
        pass


class _Transitions(_Kept):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ts long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, *at = self.last.get() if self.last.exists() else (None, -(1 << 62), -(1 << 62))
        events = []
        for pdf in rows:  # only what is after the state is kept
            ts = pdf["ts"].astype("datetime64[us]").astype("int64")
            events += [e for e in zip(ts.tolist(), pdf["seq"].tolist(), pdf["status"].tolist(), strict=True) if e[:2] > tuple(at)]
        out = []
        for ts, seq, status in sorted(events):
            if (ts, seq) <= tuple(at):
                continue
            if last is not None and status not in TRANSITIONS.get(last, ()):
                out.append((key[0], seq, last, status))
            last, at = status, (ts, seq)
        if last is not None:
            self.last.update((last, *at))
        self._again(self.handle, timerValues)
        yield pd.DataFrame(out, columns=["key", "seq", "before", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["key", "seq", "before", "status"])


def invalid_transitions(stream: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """stream (key, ts, seq, status): steps that aren't allowed, in the order of (ts, seq).

    A key's state is its last status and that status's place in the order, as typed columns; events at or before it are ignored. Keys that are
    silent for kept_ms, if it is given, are forgotten by a timer. A micro-batch's events of one key are sorted in one task: limit
    the files of a micro-batch where a key may have very many.
    """
    return _stateful(stream.groupBy("key"), _Transitions(kept_ms), "key long, seq long, before string, status string")


class _Progress(_Kept):
    """A micro-batch's rows are reduced to the newest of each document before the state is asked; a batch that ends writes no documents."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getMapState("documents", "document_id string", "status string, seq long")
        self.counts = handle.getValueState("counts", "running long, failed long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.counts.exists()
        running, failed, ended = self.counts.get() if known else (0, 0, False)
        kept = self._newest(rows) if not ended else {}
        for d in list(kept):
            s, q = kept[d]
            before = self.documents.getValue((d,)) if known and self.documents.containsKey((d,)) else None
            if before is not None and q <= before[1]:
                del kept[d]
                continue
            old = before[0] if before is not None else None
            running += (s in _RUNNING) - (old in _RUNNING)
            failed += (s == "failed") - (old == "failed")
        done = not ended and running == 0
        if not done:
            for d, row in kept.items():
                self.documents.updateValue((d,), row)
        elif known:
            self.documents.clear()
        if not (known and ended):
            self.counts.update((int(running), int(failed), bool(ended or done)))
        self._again(self.handle, timerValues)
        yield pd.DataFrame([(key[0], "partial_failed" if failed else "completed")] if done else [], columns=["batch_id", "status"])

    @staticmethod
    def _newest(rows) -> dict:
        """The first of the rows of highest seq of each document."""
        kept: dict = {}
        for pdf in rows:
            for d, s, q in zip(pdf["document_id"].tolist(), pdf["status"].tolist(), pdf["seq"].tolist(), strict=True):
                if d not in kept or q > kept[d][1]:
                    kept[d] = (s, int(q))
        return kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.documents.clear()
        self.counts.clear()
        yield pd.DataFrame([], columns=["batch_id", "status"])


_RUNNING = ("uploaded", "processing")


def batch_progress(stream: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """stream (batch_id, document_id, status, seq): the newest status of each document is kept, as an entry of a map, until its batch ends, which gives the
    batch; later events of it are ignored. Batches that are silent for kept_ms, if it is given, are forgotten by a timer."""
    return _stateful(stream.groupBy("batch_id"), _Progress(kept_ms), "batch_id string, status string")


def _stateful(groups, processor: _Kept, schema: str) -> DataFrame:
    """Needs the RocksDB state store, which ``run.ran`` and ``run.started`` set."""
    return groups.transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if processor.kept_ms is not None else "None")


#: Field ids of a micro-batch that are broadcast to a scan of the fields, at most; more are joined by a shuffle.
FEW_IDS = 1 << 19


class Recalibration:
    """For foreachBatch over corrections: fits the thresholds anew each time another n corrections have come, and publishes them.

    Which fields were corrected, how often, and their names and confidences are a keyed table that each micro-batch is added to once; so a restart goes on from
    there, and nothing grows with the number of batches. All fields are counted by name and confidence once; a fit takes what was corrected from
    these counts. Thresholds are a keyed table, too: a fit is one version, which readers
    see whole. Each row says after how many corrections it was fitted, so that a fit that was missed by a crash is made up for.
    """

    def __init__(self, ledger: Ledger, path: str, n: int = 10):
        spark = ledger.fields.sparkSession
        self.ledger, self.n = ledger, n
        self.seen = KeyedTable(spark, f"{path}/corrected", "field_id string, corrections long, field_name string, confidence double", ["field_id"])
        self.thresholds = KeyedTable(spark, f"{path}/thresholds", THRESHOLDS, ["field_name"], 1)
        self._counts: DataFrame | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        new = stored(batch.groupBy("field_id").agg(F.count("*").alias("new")), "corrected-now")
        ids = F.broadcast(new) if new.count() <= FEW_IDS else new
        named = self.ledger.fields.select(F.col("id").alias("field_id"), "field_name", "confidence").join(ids, "field_id").drop("new")
        old = self.seen.read().select(F.col("field_id").alias("old_id"), "corrections")
        both = new.join(old, F.col("field_id").eqNullSafe(F.col("old_id")), "left").join(named, "field_id", "left")
        self.seen.upsert(both.select("field_id", (F.col("new") + F.coalesce("corrections", F.lit(0))).alias("corrections"), "field_name", "confidence"), "stream", batch_id)
        now = self.corrections()
        if now // self.n > self.published() // self.n:
            fitted = fit_counts(self.counts())
            self.thresholds.upsert(fitted.select("field_name", "threshold", "samples", F.lit(now).cast("long").alias("after")))

    def counts(self) -> DataFrame:
        """How many fields of a name and a confidence (x) were (y = 1) and weren't corrected."""
        if self._counts is None:
            self._counts = stored(self.ledger.fields.where("confidence is not null").groupBy("field_name", F.col("confidence").alias("x")).agg(F.count("*").alias("n")), "field-counts")
        bad = self.seen.read().where("confidence is not null").groupBy("field_name", F.col("confidence").alias("x")).agg(F.count("*").alias("n"))
        signed = self._counts.select("field_name", "x", "n", F.lit(0).cast("long").alias("bad")).unionByName(bad.select("field_name", "x", F.lit(0).cast("long").alias("n"), F.col("n").alias("bad")))
        both = signed.groupBy("field_name", "x").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        kinds = F.array(F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("bad")).alias("n")), F.struct(F.lit(1).alias("y"), F.col("bad").alias("n")))
        return both.select("field_name", "x", F.inline(kinds)).where("n > 0")

    def corrections(self) -> int:
        return self.seen.read().agg(F.coalesce(F.sum("corrections"), F.lit(0))).first()[0]

    def published(self) -> int:
        return self.thresholds.read().agg(F.coalesce(F.max("after"), F.lit(0))).first()[0]


#: What a fit publishes: a row for each field name; a null threshold means the default.
THRESHOLDS = "field_name string, threshold double, samples long, after long"
