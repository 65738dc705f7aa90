"""Token ids in binary shards: independent zstandard frames, a trailing seek table, a checksum per frame.

A shard is: data frames (ids as little-endian unsigned 32-bit integers, whole documents), a skippable
frame with the document table, and a skippable frame in the zstd seekable format, which ends the file
and gives each frame's sizes and the low 32 bits of its content's XXH64. Any zstd tool can decompress a
shard; a reader of some documents reads the tail and then their frames only.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Kept, arrow_rows, coded, gathered, joined_bytes, new_path, slices, stored, sums_before, text_of

FRAME_BYTES = 256 << 10
_SEEK_MAGIC, _DOCS_MAGIC, _FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
_DOCS = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u4"), ("null", "<u4")])


def _marked(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SPACE = _marked(b" \t\n\x0b\x0c\r")
_ALNUM = _marked(b for b in range(128) if chr(b).isalnum())
_MARK = _marked(b for b in range(33, 127) if not chr(b).isalnum())
#: \x1C-\x1F may count as white space, and so may characters that end in these two bytes (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_MAYBE_SPACE = _SPACE | _marked(range(0x1C, 0x20))
_SPACE_END, _SPACE_MID = _marked([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]), _marked([0xC2, 0x80, 0x81, 0x9A])


class Encoder:
    """The ids of texts. Texts are cut where byte-level BPE's rules always begin a new run of characters, so the ids of
    the segments are those of the text; each distinct segment of a batch is looked up or encoded once.

    Cuts: before white space after another character; between an ASCII or Latin letter or digit and an ASCII mark;
    after a single line end. A special token's text holds no such place but its own marks, so texts with one aren't
    cut at marks. Where a byte might belong to white space outside ASCII nothing is cut.
    """

    KEPT, TOGETHER = 400_000, 4096

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self.whole(b"\n")
        if len(self.line_end) != 4:
            raise ValueError("line ends aren't ids of their own in this tokenizer")
        self.kept = Kept(self.KEPT)

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _make(self, segments: list[bytes]) -> list[bytes]:
        """Ids of new segments. Words, with a space before them or not, are encoded many at once, with line ends between them."""
        out: list[bytes | None] = [None] * len(segments)
        plain, end = [], np.frombuffer(self.line_end, dtype="<u4")[0]
        for i, s in enumerate(segments):
            word = s[1:] if s[:1] == b" " else s
            if word.decode().isalpha():
                plain.append(i)
            else:
                out[i] = self.whole(s)
        for k in range(0, len(plain), self.TOGETHER):
            part = plain[k : k + self.TOGETHER]
            raw = self.whole(b"\n" + b"\n".join([segments[i] for i in part]))
            cuts = (4 * np.flatnonzero(np.frombuffer(raw, dtype="<u4") == end)).tolist()
            for i, x, y in zip(part, cuts, [*cuts[1:], len(raw)], strict=True):
                out[i] = raw[x + 4 : y]
        return out

    @staticmethod
    def cuts(data: np.ndarray, at: np.ndarray, marks: bool = True) -> np.ndarray:
        """Places in data where a segment begins: texts' own beginnings (at, with the end of all) and the places that the class names."""
        p2, p1 = np.concatenate([[np.uint8(0)] * 2, data])[: len(data)], np.concatenate([[np.uint8(0)], data])[: len(data)]
        space = _MAYBE_SPACE[p1] | (_SPACE_END[p1] & _SPACE_MID[p2])
        mask = _SPACE[data] & ~space
        latin = (p2 == 0xC3) & (p1 >= 0x80) & (p1 != 0x97) & (p1 != 0xB7)
        if marks:
            mask |= _MARK[data] & (_ALNUM[p1] | latin)
        # A line end that is cut before is single unless white space follows.
        alone = (p1 == 10) & np.concatenate([[False], mask])[: len(data)]
        mask |= alone & (_ALNUM[data] | _MARK[data] | (data == 0xC3))
        mask[at[:-1][at[:-1] < len(data)]] = True
        return np.flatnonzero(mask)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and where each text's begin, with the end of all."""
        data, at = joined_bytes(texts)
        whole = data.tobytes()
        cuts = self.cuts(data, at, not any(s.encode() in whole for s in self.special))
        codes, segments = coded(data, cuts)
        parts = self.kept.take(segments, self._make)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = gathered(np.frombuffer(b"".join(parts), "<u4"), sums_before(sizes)[:-1][codes], sizes[codes])
        return ids, sums_before(sizes[codes])[np.searchsorted(cuts, at)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """One encoder per worker process: what it keeps serves later tasks too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode


class ShardWriter:
    def __init__(self, out):
        self.out, self.docs, self.frames, self.parts, self.size = out, [], [], [], 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, len(self.frames), self.size // 4, len(ids) // 4, doc_id is None))
        self.parts.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            data = b"".join(self.parts)
            frame = self.zstd.compress(data)
            self.out.write(frame)
            self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = np.array(self.docs, dtype=_DOCS).tobytes()
        self.out.write(struct.pack("<II", _DOCS_MAGIC, len(table)) + table)
        seek = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SEEK_MAGIC, len(seek)) + seek)


class ShardReader:
    """A shard in a seekable file."""

    def __init__(self, f, size: int):
        self.f = f
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _FOOTER_MAGIC or flags != 0x80:
            raise ValueError("not a shard with a seek table")
        head = size - 9 - 12 * n - 8
        self.frames = [struct.unpack_from("<III", self._at(head + 8, 12 * n), 12 * i) for i in range(n)]
        self.starts = np.cumsum([0] + [c for c, _, _ in self.frames]).tolist()
        _, length = struct.unpack("<II", self._at(self.starts[-1], 8))
        self.docs = np.frombuffer(self._at(self.starts[-1] + 8, length), dtype=_DOCS)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self._at(self.starts[i], packed), max_output_size=max(size, 1))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row of the document table, ids), decompressing only frames that hold wanted rows."""
        last, data = -1, b""
        for i in range(len(self.docs)) if wanted is None else sorted(wanted):
            d = self.docs[i]
            if d["frame"] != last:
                last, data = int(d["frame"]), self.frame(int(d["frame"]))
            at = 4 * int(d["offset"])
            yield i, data[at : at + 4 * int(d["n"])]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shard_chars: int = 24_000_000, shard_docs: int = 200_000) -> str:
    """Encode whole texts and write shards in ascending id order (null ids first); returns their folder.

    Null texts are empty: just the end id. Rows that share an id stay separate documents, by their text's
    hash, and rows alike in both are interchangeable. The number of shards follows the total length and the number of
    documents, so a table of many empty texts has many shards too. A task writes
    to a name of its own and then renames, so tasks that are tried again leave the same shard once.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    chars, rows = base.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-chars // shard_chars), -(-rows // shard_docs))
    placed = base.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        k, encode = TaskContext.get().partitionId(), encoder_of(tokenizer)
        own, end, n = f"{root}/.{uuid.uuid4().hex}", np.uint32(end_id).astype("<u4").tobytes(), 0
        with fs.open_output_stream(own) as out:
            shard = ShardWriter(out)
            for batch in slices(batches, most=4 << 20):
                ids, at = encode(batch.column(1))
                for i, x, y in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    shard.add(i, ids[x:y].tobytes() + end)
                n += batch.num_rows
            shard.close()
        fs.move(own, f"{root}/shard-{k:06d}.zst")
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64())], names=["shard", "docs"])

    with arrow_rows(spark, 1000):
        placed.mapInArrow(write, "shard long, docs long").agg(F.sum("docs")).first()
    return path


def read_shards(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """Every document of the shards: shard, pos, doc_id, before (ids before it in its shard), and ids (bytes), or their
    number and crc32 instead. Frames are decompressed one at a time."""
    kinds = [("shard", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64())] + ([("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] if digests else [("ids", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    shard, reader = int(name.rsplit("-", 1)[1].split(".")[0]), ShardReader(f, size)
                    before, rows, held = 0, [], 0
                    for i, ids in reader.documents():
                        d = reader.docs[i]
                        rows.append((shard, i, None if d["null"] else int(d["doc_id"]), before, *((len(ids) // 4, zlib.crc32(ids)) if digests else (ids,))))
                        before, held = before + len(ids) // 4, held + len(ids)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.zst").load(path).select("path", "length")
    return files.repartition(max(1, files.count() // 2)).mapInArrow(parse, "shard long, pos long, doc_id long, before long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the shards."""
    docs = stored(read_shards(spark, path, digests=True), "token-index")
    # One row a shard meets in the window: their number is the input's length over shard_chars.
    shards = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return docs.join(shards.drop("n"), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(path: str, shard: int, positions: list[int]) -> dict[int, np.ndarray]:
    """Ids of some documents of one shard, decompressing only their frames."""
    fs, root = pafs.FileSystem.from_uri(path)
    name = f"{root}/shard-{shard:06d}.zst"
    with fs.open_input_file(name) as f:
        return {i: np.frombuffer(ids, dtype="<u4") for i, ids in ShardReader(f, fs.get_file_info(name).size).documents(positions)}
