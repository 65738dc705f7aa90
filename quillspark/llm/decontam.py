"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words of the benchmark are numbered, and all tables are sorted numpy arrays over these numbers: about 60 bytes a word of
the benchmark, so tens of megabytes of benchmark text are searched for in one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, gathered, slices, stored, sums_before, text_of

Words = tuple[bytes, ...]

#: Windows that one cursor of a search goes over: all cursors of a batch move together. Bytes of text whose words are coded together.
RUN, SLICE = 64, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Distinct words, numbered by the order of their hashes under a seed by which no two of them collide."""

    def __init__(self, words: pa.Array):
        given = words.to_pylist()
        for self.seed in range(64):
            hashes = self._hashes(given)
            order = np.argsort(hashes)
            self.hashes = hashes[order]
            if not (self.hashes[1:] == self.hashes[:-1]).any():
                break
        self.words = words.take(pa.array(order))

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) for w in words), np.uint64, len(words))

    def codes(self, words: pa.DictionaryArray) -> np.ndarray:
        """The words' numbers, -1 for others: equal hashes are confirmed by equal words."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1, np.int32)
        hashes = self._hashes(words.dictionary.to_pylist())
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(words.dictionary, self.words.take(pa.array(place))).to_numpy(zero_copy_only=False)
        return np.where(same, place, -1).astype(np.int32)[words.indices.to_numpy()]


def _split(texts: list[list[bytes]] | list[Words]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts behind each other, and each text's number of words."""
    return pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode(), np.fromiter(map(len, texts), np.int64, len(texts))


def _hash(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each of these places."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h + codes[at + j].astype(np.uint64) + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Patterns of words, all of one length or more; a block is two words (one, for one-word patterns).

    ``blocks`` and ``shift`` say how far a window may move when its last block is found at its best place in
    any pattern (``far``, if in none). Where that is nothing, the block's place is hashed with the words before it to
    the ``bucket`` of patterns that end so, and these are compared word by word.
    """

    def __init__(self, patterns: list[Words]):
        words, sizes = _split(patterns)
        self.vocabulary = Vocabulary(words.dictionary)
        self.patterns = patterns
        self._build(self.vocabulary.codes(words), sums_before(sizes)[:-1], sizes, len(words.dictionary))

    @classmethod
    def of_windows(cls, flat: np.ndarray, first: np.ndarray, size: int, words: int) -> WuManber:
        """Windows of one size that begin at these places of coded texts; windows alike are given once."""
        self = cls.__new__(cls)
        self._build(flat, first, np.full(len(first), size, np.int64), words)
        return self

    def _build(self, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, words: int) -> None:
        self.flat, self.first, self.sizes, self.words = flat, first, sizes.astype(np.int32), words
        self.m = m = int(sizes.min())
        self.block = b = min(2, m)
        self.far = far = m - b + 1
        # The least shift of the block at each place of the texts, then of each distinct block.
        best = np.full(len(flat), far, np.int16 if far < 1 << 15 else np.int64)
        for j in range(far):
            best[first + j] = np.minimum(best[first + j], m - b - j)
        at = np.flatnonzero(best < far)
        keys = self._keys(flat, at)
        order = np.argsort(keys, kind="stable")
        self.blocks, begin = np.unique(keys[order], return_index=True)
        self.shift = np.minimum.reduceat(best[at][order], begin)
        bucket = self._bucket(flat, first, np.searchsorted(self.blocks, self._keys(flat, first + m - b)))
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        self.bucket = bucket[self.order]

    def _keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks at these places as numbers, -1 where a word is unknown."""
        a = codes[at].astype(np.int64)
        if self.block == 1:
            return a
        b = codes[at + 1].astype(np.int64)
        return np.where((a < 0) | (b < 0), -1, a * self.words + b)

    def _bucket(self, codes: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        h = (_hash(codes, at, self.m - self.block) + place.astype(np.uint64)) * _STEP
        return h ^ (h >> np.uint64(31))

    def search(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence within the texts, whose codes stand behind each other."""
        m, b = self.m, self.block
        start, n = sums_before(sizes)[:-1], np.maximum(sizes - m + 1, 0)
        runs = -(-n // RUN)
        text = np.repeat(np.arange(len(sizes)), runs)
        at = start[text] + RUN * (np.arange(len(text)) - np.repeat(sums_before(runs)[:-1], runs))
        stop = np.minimum(at + RUN, (start + n)[text])
        end = (start + sizes)[text]
        met = []
        while len(at):
            keys = self._keys(codes, at + m - b)
            place = np.minimum(np.searchsorted(self.blocks, keys), len(self.blocks) - 1)
            skip = np.where(self.blocks[place] == keys, self.shift[place], self.far)
            here = skip == 0
            met.append((at[here], place[here], end[here]))
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop, end = at[on], stop[on], end[on]
        if not met:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at, place, end = (np.concatenate(x) for x in zip(*met, strict=True))
        wanted = self._bucket(codes, at, place)
        low = np.searchsorted(self.bucket, wanted)
        several = np.searchsorted(self.bucket, wanted, side="right") - low
        pattern = gathered(self.order, low, several)
        at, end = np.repeat(at, several), np.repeat(end, several)
        size, first = self.sizes[pattern], self.first[pattern]
        same = at + size <= end
        for j in range(int(size.max(initial=0))):
            on = np.flatnonzero(same & (j < size))
            same[on] = codes[at[on] + j] == self.flat[first[on] + j]
        return at[same], pattern[same]

    def find(self, words: Words) -> Iterator[tuple[int, Words]]:
        """(place, pattern) in one text."""
        coded, sizes = _split([words])
        for at, p in zip(*self.search(self.vocabulary.codes(coded), sizes), strict=True):
            yield int(at), self.patterns[p]


def windows(words: Words, n: int) -> list[Words]:
    """All runs of n words; fewer words, but not none, are one window."""
    return [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words] if words else []


def _distinct(flat: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where one of each of the distinct windows begins, each window's number among these)."""
    h = _hash(flat, first, n)
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    agree = np.ones(len(first), bool)
    for j in range(n):
        agree &= flat[first + j] == flat[first[one[number]] + j]
    odd = np.flatnonzero(~agree)  # a hash that two windows share: these stand for themselves
    number[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([first[one], first[odd]]), number


class Benchmark:
    """The coded windows of benchmark rows (item, text): a search for each window length, and the items of each distinct window."""

    def __init__(self, rows: list[tuple[str, bytes]], n: int):
        self.names = sorted({item for item, _ in rows})
        number = {name: i for i, name in enumerate(self.names)}
        words, sizes = _split([alnum_words(bytes(text)) for _, text in rows])
        self.vocabulary = Vocabulary(words.dictionary)
        flat, start = self.vocabulary.codes(words), sums_before(sizes)[:-1]
        item = np.fromiter((number[i] for i, _ in rows), np.int32, len(rows))
        self.searches = []
        for m in np.unique(np.minimum(sizes, n)).tolist():
            if not m:
                continue
            own = np.flatnonzero(np.minimum(sizes, n) == m)
            many = sizes[own] - m + 1
            first = np.arange(many.sum()) + np.repeat(start[own] - sums_before(many)[:-1], many)
            begin, window = _distinct(flat, first, m)
            pairs = np.unique(window * len(self.names) + np.repeat(item[own], many))
            held = np.searchsorted(pairs // len(self.names), np.arange(len(begin) + 1))
            self.searches.append((WuManber.of_windows(flat, begin, m, len(words.dictionary)), held, (pairs % len(self.names)).astype(np.int32)))

    def search(self, codes: np.ndarray, sizes: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ends of occurrences to ``hit`` (1 where one begins, -1 behind it); returns pairs of text and item."""
        text_of_word = np.repeat(np.arange(len(sizes)), sizes)
        found = [np.zeros(0, np.int64)]
        for search, held, items in self.searches:
            at, pattern = search.search(codes, sizes)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + search.m, -1)
            met = np.unique(text_of_word[at] * len(search.first) + pattern)
            text, pattern = met // len(search.first), met % len(search.first)
            several = held[pattern + 1] - held[pattern]
            found.append(np.unique(np.repeat(text, several) * len(self.names) + gathered(items, held[pattern], several)))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)


_HITS = "array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, rows: list, n: int, only_hits: bool = False) -> DataFrame:
    """docs (id, text, row, hits, items, held) without the text, with the number of words and the hits of these benchmark rows added."""
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(rows, n))
    hit_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in slices(batches, most=SLICE):
            words, sizes = _split([alnum_words(t) for t in batch.column("text").to_pylist()])
            codes, start = bench.vocabulary.codes(words), sums_before(sizes)
            hit = np.zeros(len(codes) + 1, np.int64)
            old = batch.column("hits")
            if len(old.flatten()):
                base = start[pc.list_parent_indices(old).to_numpy()]
                np.add.at(hit, base + pc.struct_field(old.flatten(), "start").to_numpy(), 1)
                np.add.at(hit, base + pc.struct_field(old.flatten(), "end").to_numpy(), -1)
            text, item = bench.search(codes, sizes, hit)
            # Runs of hit words, each within one text.
            inside = np.cumsum(hit)[:-1] > 0
            border = np.zeros(len(codes) + 1, bool)
            border[start] = True
            opens = np.flatnonzero(inside & (border[:-1] | ~np.append(False, inside[:-1])))
            closes = np.flatnonzero(inside & (border[1:] | ~np.append(inside[1:], False))) + 1
            owner = np.repeat(np.arange(len(sizes)), sizes)[opens]
            offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array((x - start[owner]).astype(np.int32)) for x in (opens, closes)], fields=list(hit_type))
            items = batch.column("items").to_pylist()
            cuts = np.searchsorted(text, np.arange(len(sizes) + 1))
            for i in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                new = [bench.names[x] for x in item[cuts[i] : cuts[i + 1]].tolist()]
                items[i] = sorted({*items[i], *new}) if items[i] else new
            done = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(items, pa.list_(pa.string())), batch.column("held")],
                names=["id", "row", "n_words", "hits", "items", "held"],
            )
            yield done.filter(pc.greater(pc.list_value_length(done.column("hits")), 0)) if only_hits else done

    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = ["id", "row", "n_words", "hits", "items", "held"]
    return docs.mapInArrow(scan, ", ".join(f"`{c}` {kind.get(c, 'bigint')}" for c in names))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, share: int = 20, slice_bytes: int = 24 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of documents inside any occurrence of a benchmark window, and whether they are too many.

    Returns per input row: the id, ``n_words``, ``hits`` (merged word spans, end exclusive), ``items``
    (ids as strings, sorted), ``n_hit``, ``n_items`` and ``contaminated``: n_hit > 0 and share * n_hit >= n_words;
    and the columns to ``keep``.

    The search tables of about ``slice_bytes`` of distinct benchmark rows (some ten times that) are broadcast, sized by a sum first. A
    larger benchmark takes a pass over the documents for each further slice, which writes only the ids, text digests and hits of
    documents that have any; the last pass joins these in. Null or empty texts have no words and no hits; an empty benchmark finds
    nothing; repeated benchmark rows act as one and a null item id is named ''. Each input row is judged on its own, rows with null ids too.
    """
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).cast("binary").alias("text")).distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // slice_bytes))
    text = text_of(text_col).cast("binary")
    row = F.lit("") if passes == 1 else F.sha2(text, 256)
    none = {"hits": F.array().cast(_HITS), "items": F.array().cast("array<string>")}
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), row.alias("row"), F.struct(F.lit(0).alias("_"), *keep).alias("held"))
    slice_of = lambda k: [tuple(r) for r in bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()]
    before = None
    for k in range(passes - 1):
        bare = out.drop("held").withColumns(none).withColumn("held", F.lit(0))
        met = stored(_scan(bare, slice_of(k), window, only_hits=True).select("id", "row", "hits", "items"), "decontam-hits")
        before = met if before is None else before.unionByName(met)
    if before is None:
        out = out.withColumns(none)
    else:
        # Copies with one id have the same hits: one row of each pass stands for them.
        each = before.groupBy("id", "row").agg(F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("items")).alias("items"))
        each = each.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "hits", "items")
        out = out.join(each, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("id", "text", "row", "held", *[F.coalesce(c, none[c]).alias(c) for c in none])
    out = _scan(out, slice_of(passes - 1), window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return (
        out.select(F.col("id").alias(id_col), "n_words", "hits", "items", *[F.col("held")[c].alias(c) for c in keep])
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )
