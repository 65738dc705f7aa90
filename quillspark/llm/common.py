"""What the operators of this package share: the shared folder, byte-level words and ASCII rules.

Row rules that hold in every operator unless its docstring says otherwise: a null text counts as
empty, only the named columns are read (so other columns may have any names), a null id is a value
like any other, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; a cluster fails."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str, compression: str = "zstd", **options: str) -> DataFrame:
    """df written to a new table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(compression=compression, **options).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Session settings for the jobs that are run inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most so many rows for the jobs run inside: whole texts make the usual 10,000 rows too large."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": rows})


#: Bits of a mark of keys: 2,048 rows of 4 kB at most when broadcast.
MARK_BITS, _ROW_BITS = 1 << 26, 1 << 15


def flagged(rows: DataFrame, keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """rows with a column that is true where the key in cols is among the keys, and for a few others: keys are one bit each in a
    bitmap of fixed size, which is broadcast. So it may only save work."""
    bit = F.pmod(F.xxhash64(*cols), F.lit(MARK_BITS))
    where = lambda df: df.withColumns({"_row": (bit / _ROW_BITS).cast("int"), "_bit": (bit % _ROW_BITS).cast("int")})
    bits = where(keys).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = where(rows).join(F.broadcast(bits), "_row", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
    return held.select(*rows.columns, F.expr("(_byte >> (_bit % 8)) & 1 = 1").alias(name))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many bytes of text (one row at least), so that what Python makes of a batch stays small."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_bytes(texts: pa.Array, lead: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind each other, each after ``lead``, and where each begins, with the end of all."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = pc.binary_join_element_wise(pa.scalar(lead, pa.large_binary()), texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def coded(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The segments of data that begin at each of the cuts, as places in the list of distinct ones."""
    ends = np.append(cuts, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def sums_before(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of the pool behind each other: run i has ``sizes[i]`` members from place ``first[i]``."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]


class Kept:
    """What was found for keys of up to LONGEST bytes, in two generations of bounded size: the older goes when the newer is full."""

    LONGEST = 64

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def take(self, keys: list[bytes], make) -> list:
        """The values of keys; ``make`` gives those of the list of keys that aren't kept."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, keys))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            fresh = []
            for i in gaps:
                x = found[i] = old.get(keys[i])
                if x is None:
                    fresh.append(i)
                else:
                    new[keys[i]] = x
            for i, x in zip(fresh, make([keys[i] for i in fresh]) if fresh else (), strict=True):
                found[i] = x
                if len(keys[i]) <= self.LONGEST:
                    new[keys[i]] = x
        return found


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does just that, and fast, where every character is ASCII."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def white_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return text.lower().split()


#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] stay (A-Z as a-z), others become a space.
_ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text after lower-casing A-Z."""
    return text.translate(_ALNUM).split()
