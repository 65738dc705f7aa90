"""Run a stream over what is there now and read its result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import shared_folder
from ..sources.tables import KeyedTable

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Starts a query with its state in RocksDB, on the executors' disks and in the checkpoint, not in their heaps."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(STATE_STORE, before)


def ran(stream: DataFrame, mode: str, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The result of a stream after all available input: appended rows, or in update mode the newest row of each key. A path that was used before goes on from there."""
    spark = stream.sparkSession
    path = path or shared_folder(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        with_rocksdb(spark, writer.format("parquet").option("path", path).start).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    table = KeyedTable(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema), keys)
    sink = functools.partial(_upsert, table)
    with_rocksdb(spark, writer.foreachBatch(sink).start).awaitTermination()
    return table.read()


def _upsert(table: KeyedTable, batch: DataFrame, batch_id: int) -> None:
    table.upsert(batch, "stream", batch_id)
