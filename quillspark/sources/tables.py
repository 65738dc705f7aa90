"""A table by keys whose writes are seen whole or not at all."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, folder string, version long"


class KeyedTable:
    """Rows with one row per key, in buckets of keys, under a path.

    A write stages the touched buckets in a folder of its own, then adds a manifest, one small file that names the folder of every bucket:
    readers take the newest, so that they see the rows before or after. A failed write leaves nothing that a manifest names. Two writers of the same version:
    the second fails. A stream's writer gives its micro-batch's id, which the manifest keeps: a batch that comes again changes nothing.
    Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.bucket_by = spark, path, keys, buckets, bucket_by or keys
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.fieldNames()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, str], dict[str, int]]:
        """Version (0: nothing written), folder of each bucket, and last batch of each writer (kept as rows of bucket -1)."""
        root = f"{self.path}/manifest"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [p.getPath().getName() for p in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in done if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
        if not done:
            return 0, {}, {}
        last = max(int(n[1:]) for n in done)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{root}/v{last}").collect()  # a row for each bucket and writer
        return last, {r.bucket: r.folder for r in rows if r.bucket >= 0}, {r.folder: r.version for r in rows if r.bucket < 0}

    def read(self) -> DataFrame:
        return self._rows(sorted(self.manifest()[1].values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _buckets(self, folder: str) -> set[int]:
        """The buckets that a folder has rows of, from its folders' names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        names = [p.getPath().getName() for p in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
        return {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}

    def upsert(self, rows: DataFrame, writer: str | None = None, batch: int = 0) -> bool:
        """Puts rows (one for each key) in, or over those of the same keys. False: the writer's batch was there already."""
        return self._write(rows, self.keys, writer, batch)

    def replace(self, rows: DataFrame, by: list[str], writer: str | None = None, batch: int = 0) -> bool:
        """Puts rows in, and removes all others of the same ``by``. Only the buckets of these are rewritten if rows are dealt by columns of ``by``, else all."""
        return self._write(rows, by, writer, batch)

    def _write(self, rows: DataFrame, by: list[str], writer: str | None, batch: int) -> bool:
        version, folders, batches = self.manifest()
        if writer is not None and batches.get(writer, -1) >= batch:
            return False
        folder = f"{self.path}/data/{version + 1}-{uuid.uuid4().hex}"
        rows.select(*self.columns).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        touched = self._buckets(folder)
        if not set(self.bucket_by) <= set(by):
            touched |= set(folders)
        before = sorted(folders[b] for b in touched if b in folders)
        written = touched
        if before:  # the rows are read from where they are staged, so that they are worked out once
            staged = self._rows([f"{folder}/_bucket={b}" for b in sorted(self._buckets(folder))])
            gone = staged.select(*[F.col(k).alias(f"_{k}") for k in by]).distinct()
            same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by])
            kept = self._rows(before).join(gone, same, "left_anti")
            folder = f"{self.path}/data/{version + 1}-{uuid.uuid4().hex}"
            kept.unionByName(staged).withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            written = self._buckets(folder)
        now = {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in written}
        if writer is not None:
            batches[writer] = batch
        named = [(b, f, version + 1) for b, f in now.items()] + [(-1, w, n) for w, n in batches.items()]
        self.spark.createDataFrame(named, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/v{version + 1}")
        return True
