"""Content-addressed WARC archives: payload bytes once, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import new_path, stored

_END = "\r\n\r\n"
#: RFC 4648 base32, and the digits that conv() writes.
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of 160 bits given as 40 hex digits: five of these (20 bits) are four base32 digits."""
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hex40, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]), _DIGITS, _BASE32)


@F.pandas_udf(BinaryType())
def _packed(payloads: pd.Series) -> pd.Series:
    zstd = zstandard.ZstdCompressor(level=3)
    return payloads.map(zstd.compress)


@F.pandas_udf(BinaryType())
def _unpacked(packed: pd.Series) -> pd.Series:
    zstd = zstandard.ZstdDecompressor()
    return packed.map(zstd.decompress)


def _http(length: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(_END))


def content_addressed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, payloads), both stored: exact record headers with a payload key, and each payload once, as a zstandard frame.

    The key is the payload's SHA-256. Its uniqueness is verified: payloads with one key must agree in
    length and in an independent 64-bit hash, else the job fails. Of records with equal payloads of at
    least ``min_bytes``, the smallest id is the response and others are revisits of it; with shorter
    payloads every record is a response. A null payload is empty. Rows that repeat the smallest id
    with the same payload are responses too; a null id is a response only where all ids of its payload
    are null. Line breaks in a url are percent-encoded, a null url is empty.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    heads = base.select("page_id", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), F.unhex(F.sha2("payload", 256)).alias("key"), F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("check"))
    heads = stored(heads, "warc-heads")  # digests are computed once
    same = heads.groupBy("key").agg(F.min("page_id").alias("first_id"), (F.min("check").eqNullSafe(F.max("check")) & (F.min("bytes") == F.max("bytes"))).alias("ok"))
    same = same.where(F.assert_true("ok", F.lit("payloads differ under one SHA-256")).isNull()).drop("ok")
    is_response = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("bytes") < min_bytes)
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = _http(F.col("bytes"))
    length = F.octet_length("http") + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    records = (
        heads.join(same, "key")
        .withColumn("type", F.when(is_response, "response").otherwise("revisit"))
        .withColumn("http", http)
        .withColumn(
            "header",
            F.concat(
                F.lit("WARC/1.1\r\n"),
                line("WARC-Type", F.col("type")),
                line("WARC-Record-ID", urn(F.col("page_id"))),
                line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
                line("WARC-Target-URI", F.col("url")),
                line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.hex("sha1")))),
                F.when(F.col("type") == "response", "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first_id"))))),
                line("Content-Type", F.lit("application/http; msgtype=response")),
                line("Content-Length", length.cast("string")),
                F.lit("\r\n"),
                F.col("http"),
            ),
        )
        .select("page_id", "key", "first_id", "type", "bytes", "header")
    )
    records = stored(records, "warc-records")
    one = records.where("type = 'response'").groupBy("key").agg(F.min("page_id").alias("one_id"))
    holders = base.select("page_id", F.unhex(F.sha2("payload", 256)).alias("key"), _packed("payload").alias("packed")).join(one.withColumnRenamed("key", "one_key"), (F.col("key") == F.col("one_key")) & F.col("page_id").eqNullSafe(F.col("one_id")), "left_semi")
    # A key has one holder id, so these columns are as good as the key alone, and the join's partitions serve both.
    payloads = stored(holders.dropDuplicates(["key", "page_id"]).select("key", "packed"), "warc-payloads")
    return records, payloads


def rebuilt(records: DataFrame, payloads: DataFrame, parts: int = 0) -> DataFrame:
    """Every record's original bytes (page_id, type, record): a response's header joined with its payload; a revisit has none.

    With parts, responses and revisits are dealt to so many partitions each: responses by their payload, of which each
    has few, and revisits, of which one payload may have very many, by page.
    """
    response, revisit = records.where("type = 'response'"), records.where("type <> 'response'")
    if parts:  # both sides are dealt once, for the join and for what follows
        response, payloads = response.repartition(parts, "key"), payloads.repartition(parts, "key")
        revisit = revisit.repartition(parts, "page_id", "header")
    whole = response.join(payloads, "key").select("page_id", "type", F.concat(F.col("header").cast("binary"), _unpacked("packed")).alias("record"))
    return whole.unionByName(revisit.select("page_id", "type", F.col("header").cast("binary").alias("record")))


def write_warc(spark: SparkSession, records: DataFrame, payloads: DataFrame, path: str | None = None, file_bytes: int = 16 << 20) -> str:
    """gzipped archives of about file_bytes before compression. Records end in CRLF CRLF: the text writer's line end here."""
    path = path or new_path(spark, "warc-archive")
    total = records.agg(F.sum(F.octet_length("header")), F.sum(F.when(F.col("type") == "response", F.col("bytes")))).first()
    files = max(1, -(-sum(x or 0 for x in total) // file_bytes))
    rebuilt(records, payloads, files).select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)
    return path


_FIELDS = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())]


def _records(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:] if x)
        stop = end + int(head["Content-Length"])
        body = data.index(b"\r\n\r\n", end, stop) + 4
        http = dict(x.split(b": ", 1) for x in data[end:body].split(b"\r\n")[1:] if x)
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        digest = "sha1:" + base64.b32encode(hashlib.sha1(data[body:stop]).digest()).decode()
        if head["WARC-Type"] == "response" and (digest != head["WARC-Payload-Digest"] or stop - body != int(http[b"Content-Length"])):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} isn't what its headers say")
        yield head["WARC-Record-ID"], head["WARC-Type"], head["WARC-Target-URI"], head.get("WARC-Refers-To"), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http[b"Content-Length"]), data[at:body], data[body:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of gzipped archives: headers parsed, exact header bytes, payload bytes (null if not asked for).

    A response's payload is hashed and measured as it is read: one that isn't as its headers say fails the job.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(_records(gzip.decompress(data)))
                cols = [pa.array([r[i] if payload or name != "payload" else None for r in rows], kind) for i, (name, kind) in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in _FIELDS])

    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, header binary, payload binary"
    # One file a task: a file is bounded when written.
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(parse, schema)


def revisits_agree(found: DataFrame) -> bool:
    """Whether each revisit of read_warc's rows names a response of the same payload digest and size, which was checked on reading."""
    asked = found.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    given = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return asked.join(given, ["refers_to", "payload_digest", "payload_bytes"], "left_anti").isEmpty()
