"""Katz backoff scoring: Good-Turing discounted bigram counts with exactly normalised backoff weights.

One shuffle deals the corpus: each bigram (h, w) of each document goes, packed with others, to a bucket
where all occurrences of it meet, with the training count of w. A bucket counts its bigrams and, in the
same pass, gives each document what does not depend on global figures: how many of its tokens
continue a seen bigram, by count class, and which have to back off after which history. Discounts and
backoff weights are then joined in, history by history, and summed per document.

The model is a set of tables: unigrams, bigrams, and histories with their backoff weights. ``score_texts``
evaluates any texts by joins with them, token by token: a bigram's own probability if it is there, else
the history's weight times the word's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, flagged, settings, slices, stored, text_of
from .jaccard import _NO_ID, _mixed

#: Counts up to K are discounted by Good-Turing, larger ones are trusted.
K = 5
#: Keys of the start and the end of a text; words' keys are odd.
START, END = 0, 2
#: Words of the broadcast vocabulary, by count: at most so many (12 bytes each).
FREQUENT = 1 << 18
#: Words whose bigrams are counted before any shuffle, so no bucket gets "of the" of all texts.
HOT = 1024
#: Bytes of text that are dealt together, and folders of the stored tables.
PART, FOLDERS = 4 << 20, 16
#: Occurrences a bucket holds about, and buckets at least. A text has a row of sums for each bucket that it meets: with few buckets
#: these rows would grow with the square of the input until there are more buckets than a text has words.
BUCKET, BUCKETS = 1 << 20, 128
#: Tokens of a bucket that are settled together, at least.
SETTLED = 1 << 18
#: What a count over K gives up, so that every history leaves mass for backing off.
TRUST = 0.01


def good_turing(classes: dict[int, int]) -> np.ndarray:
    """Discounts d_1..d_K by the counts of counts n_1..n_K+1 (Katz 1987): d_r = (r*/r - c) / (1 - c), c = (K+1) n_K+1 / n_1.

    A class whose discount isn't strictly between 0 and 1 (as of odd counts of counts), or any class where a
    count of counts is 0, loses half a count instead, since mass must be left for unseen words.
    """
    n = [float(classes.get(r, 0)) for r in range(1, K + 2)]
    fallback = np.array([1 - 0.5 / r for r in range(1, K + 1)])
    if min(n) <= 0:
        return fallback
    c = (K + 1) * n[K] / n[0]
    d = np.array([((r + 1) * n[r] / n[r - 1] / r - c) / (1 - c) if c != 1 else 0.0 for r in range(1, K + 1)])
    return np.where((d > 0) & (d < 1), d, fallback)


def _batches(pdf: pd.DataFrame, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Rows in parts of about so many bytes of text."""
    part = pdf["text"].map(len).cumsum() // most
    for _, x in pdf.groupby(part, sort=False):
        yield x


#: Bytes of words that are hashed by eights, all words at once; longer words are hashed one by one.
_LONG = 256


def _keys(words: pa.Array) -> np.ndarray:
    """Odd 64-bit keys of words: their length, then each eight bytes mixed in."""
    n, (_, ends, data) = len(words), words.buffers()
    if not n:
        return np.zeros(0, np.int64)
    at = np.frombuffer(ends, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    padded = np.append(np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = np.diff(at)
    h = _mixed(size.astype(np.uint64))
    left = np.flatnonzero(size <= _LONG)
    for done in range(0, _LONG, 8):
        left = left[size[left] > done]
        if not len(left):
            break
        kept = np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * np.minimum(size[left] - done, 8).astype(np.uint64))
        h[left] = _mixed(h[left] ^ (eights[at[left] + done] & kept))
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(words[i].as_py())
    return (h | np.uint64(1)).view(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, each token's place among them, each token's text): END is key 0 of the list.

    The bytes are taken as text as they are: both functions know ASCII only, and the white space of the contract is theirs.
    """
    as_text = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    split = pc.ascii_split_whitespace(pc.ascii_lower(as_text))
    of = pc.list_parent_indices(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    words, place = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
    none = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if none >= 0:  # at the ends of texts with white space there, and of empty ones
        kept = np.arange(len(words)) != none
        of, place = of[place != none], (np.cumsum(kept) - 1)[place[place != none]]
        words = words.filter(pa.array(kept))
    sizes = np.bincount(of, minlength=len(texts))
    place = np.insert(place + 1, np.cumsum(sizes), 0)
    return np.append(np.int64(END), _keys(words)), place, np.repeat(np.arange(len(texts)), sizes + 1)


@dataclass
class Known:
    """What tasks know of the corpus: the frequent words (keys sorted) with training counts, hot ones, and totals."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    texts: int
    d1: np.ndarray
    free: float  # the unknown type's probability
    scale: float  # what seen words keep; under 1 only where discounts leave nothing for the unknown type
    hot: np.ndarray  # places in keys of hot words, sorted by key
    hot_counts: np.ndarray  # training counts of pairs of START or hot words (rows) and hot words

    def p1(self, c: np.ndarray) -> np.ndarray:
        """Discounted unigram probability by training count; count 0 is the one unknown type, with all the mass that is left."""
        d = np.append(np.append(0.0, self.d1), 1.0)[np.minimum(c, K + 1).astype(np.int64)]
        return np.where(c > 0, self.scale * d * c / max(self.tokens, 1), self.free)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys among the frequent ones, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


_OUT = "kind string, doc_id long, tag long, h long, n long, known long, k1 long, k2 long, k3 long, k4 long, k5 long, x double, y double, payload binary"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


_KS = [f"k{r}" for r in range(1, K + 1)]
#: The columns that rows of a kind use. Buckets' results are stored as few rows of arrays, so a million bigrams aren't a million rows on the way.
_USED = {"row": ["doc_id", "tag", "n", "known", "k1", "k2", "y"], "text": ["doc_id", "tag", "known", *_KS, "x", "y"], "back": ["doc_id", "tag", "h", "n", "known"], "history": ["h", "n", "known", *_KS, "x", "y"], "counts": ["h", "n", "known"]}
_ARRAYS = "kind string, " + ", ".join(f"{c} array<{t}>" for c, t in (x.split() for x in _OUT.split(", ")) if c not in ("kind", "payload"))
_ARROW = pa.schema([("kind", pa.string()), *((c, pa.list_(pa.float64() if t == "double" else pa.int64())) for c, t in (x.split() for x in _OUT.split(", ")) if c not in ("kind", "payload"))])
#: Members of an array, and rows of figures that are passed on together. Parquet's reader decodes 4,096 rows at once, whatever their arrays hold:
#: with long arrays that is a whole row group of all columns in each task's heap.
_TOGETHER, _PASSED = 1 << 6, 1 << 12


def _arrays(pdf: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    """Rows of one or more kinds as rows of arrays."""
    for kind, rows in pdf.groupby("kind", sort=False):
        for at in range(0, len(rows), _PASSED):
            part = rows.iloc[at : at + _PASSED]
            ends = pa.array(np.append(np.arange(0, len(part), _TOGETHER), len(part)), pa.int32())
            n = len(ends) - 1
            cols = [pa.ListArray.from_arrays(ends, pa.array(part[f.name].to_numpy(), f.type.value_type)) if f.name in _USED[kind] else pa.nulls(n, f.type) for f in _ARROW if f.name != "kind"]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), *cols], schema=_ARROW)


def _rows(met: DataFrame, kind: str) -> DataFrame:
    return met.where(F.col("kind") == kind).selectExpr(f"inline(arrays_zip({', '.join(_USED[kind])}))")


def _frame(kind: str, **cols) -> pd.DataFrame:
    n = len(next(iter(cols.values())))
    out = pd.DataFrame({c: cols.get(c, np.zeros(n, np.int64) if c not in ("x", "y") else np.zeros(n)) for c in _COLUMNS if c not in ("kind", "payload")})
    out["kind"], out["payload"] = kind, cols.get("payload", None)
    return out[_COLUMNS]


def _classes(group: np.ndarray, size: int, c: np.ndarray) -> dict[str, np.ndarray]:
    return {f"k{r}": np.bincount(group[c == r], minlength=size) for r in range(1, K + 1)}


def _settle(known: Known, ids: np.ndarray, tags: np.ndarray, train: np.ndarray, d: np.ndarray, h: np.ndarray, hc: np.ndarray, c1: np.ndarray, c2: np.ndarray, rare_w: np.ndarray) -> pd.DataFrame:
    """What each text gets from tokens with known counts.

    d: the token's text; h, hc: its history's key and frequent code (-1: rare); c1, c2: training counts of word
    and bigram. Row kinds: ``text`` has sums for a text (of known words and base scores only for rare words: others' are in its ``row``); ``back`` has a held-out text's tokens whose history's
    figures are still unknown: n of them back off, known of them are seen after a rare history.
    """
    size, seen, held = len(ids), c2 > 0, ~train[d]
    ch = np.where(hc >= 0, np.append(known.counts, [known.texts, 1])[hc], 1)
    with np.errstate(divide="ignore"):
        x = np.where(seen, np.log10(np.where(c2 > K, c2 - TRUST, np.maximum(c2, 1))) - np.log10(np.maximum(ch, 1)), np.log10(known.p1(c1)))
    # In a training text a rare word's next token is always seen after it: that token's share of 1 / c(h) is taken here.
    x -= np.where(rare_w & train[d], np.log10(np.maximum(c1, 1)), 0.0)
    low = np.where(seen, c2, 0)
    used = np.flatnonzero(np.bincount(d, minlength=size))
    sums = {c: np.bincount(d, w, size)[used] for c, w in (("x", x), ("y", np.where(rare_w, np.log10(c1 + 1.0), 0.0)), ("known", rare_w & (c1 > 0)))}
    out = [_frame("text", doc_id=ids[used], tag=tags[used], known=sums["known"].astype(np.int64), x=sums["x"], y=sums["y"], **{k: v[used] for k, v in _classes(d, size, low).items()})]
    ask = np.flatnonzero(held & (~seen | (hc < 0)))
    if len(ask):
        pair, first, inv = np.unique(_mixed((d[ask].astype(np.uint64) << np.uint64(40)) ^ _mixed(h[ask].view(np.uint64))), return_index=True, return_inverse=True)
        a = ask[first]
        out.append(_frame("back", doc_id=ids[d[a]], tag=tags[d[a]], h=h[a], n=np.bincount(inv, ~seen[ask], len(pair)).astype(np.int64), known=np.bincount(inv, seen[ask], len(pair)).astype(np.int64)))
    return pd.concat(out)


def _histories(h: np.ndarray, c2: np.ndarray, p1: np.ndarray) -> pd.DataFrame:
    """Per history of distinct seen bigrams, which come history by history: numbers by count class, number (n) and sum (known) of larger counts,
    sum of p1 (x) and number of the counts K + 1 (y)."""
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    keys, g = h[new], np.cumsum(new) - 1
    big = c2 > K
    return _frame("history", h=keys, n=np.bincount(g, big, len(keys)).astype(np.int64), known=np.bincount(g, np.where(big, c2, 0), len(keys)).astype(np.int64), x=np.bincount(g, p1, len(keys)), y=np.bincount(g, c2 == K + 1, len(keys)).astype(float), **_classes(g, len(keys), c2))


#: Ids, tags and training marks of texts; rare words' keys; histories (each less the one before), words and texts of bigrams.
_PACKED = ("<i8", "<i8", "?", "<i8", "<i4", "<i4", "<i4")


def _planes(a: np.ndarray, kind: str) -> bytes:
    """The members' first bytes, then their second ones, and so on: alike bytes stand together."""
    return np.ascontiguousarray(a, dtype=kind).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def _pack(arrays: list[np.ndarray], kinds: tuple[str, ...] = _PACKED) -> bytes:
    """Arrays of these kinds as one compressed block: their lengths first."""
    head = np.array([len(a) for a in arrays], dtype="<i8")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(_planes(a, k) for a, k in zip(arrays, kinds, strict=True)))


def _unpack(data: bytes, kinds: tuple[str, ...] = _PACKED) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for n, k in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _sorted(cols: tuple[np.ndarray, ...], below: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Columns of numbers below these, sorted by the first, then the second and so on: packed into one number a row, if it takes 63 bits at most."""
    bits = [int(n).bit_length() for n in below]
    if sum(bits) > 63:
        order = np.lexsort(cols[::-1])
        return tuple(c[order] for c in cols)
    packed = np.zeros(len(cols[0]), dtype=np.int64)
    for c, n in zip(cols, bits, strict=True):
        packed = (packed << n) | c
    packed.sort()
    out = []
    for n in reversed(bits):
        out.append(packed & ((1 << n) - 1))
        packed = packed >> n
    return tuple(reversed(out))


def _deal(known: Known, buckets: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the bigrams of hot words here; pack others for their buckets: of the word, if it is rare, else of the
    history, and for histories that may fill a good part of a bucket of both."""
    keys, place, d = _tokens(pa.array(pdf["text"], pa.binary()))
    ids, tags, train = pdf["doc_id"].to_numpy(), pdf["tag"].to_numpy(), ~pdf["held"].to_numpy().astype(bool)
    start, rare = len(known.keys), len(known.keys) + 1
    codes = known.codes(keys)
    codes = np.where(codes >= 0, codes, rare + np.arange(len(keys)))
    w = codes[place]
    h = np.append(start, w[:-1])
    h[np.append(True, d[1:] != d[:-1])] = start
    is_hot = np.zeros(rare + len(keys), dtype=bool)
    is_hot[known.hot] = is_hot[start] = True
    both = is_hot[h] & is_hot[w]
    key_of = np.concatenate([known.keys, [START], keys])
    count = np.append(known.counts, np.zeros(1 + len(keys), np.int64))[w]
    each = lambda v: np.bincount(d, v, len(ids))
    sums = {"k1": each(None).astype(np.int64), "k2": each(count > 0).astype(np.int64), "y": each(np.where(w < start, np.log10(count + 1.0), 0.0))}
    out = [_frame("row", doc_id=ids, tag=tags, n=(~train).astype(np.int64), known=np.ones(len(ids), np.int64), **sums)]
    if both.any():
        row = np.zeros(start + 1, dtype=np.int64)
        row[known.hot] = np.arange(1, len(known.hot) + 1)  # START is row 0
        hw, hh = w[both], h[both]
        out.append(_settle(known, ids, tags, train, d[both], key_of[hh], hh, known.counts[hw], known.hot_counts[row[hh], row[hw] - 1], np.zeros(len(hw), bool)))
    w, h, d = w[~both], h[~both], d[~both]
    mix = _mixed(key_of.view(np.uint64))
    # A word outside the broadcast ones is no more frequent than the last of these.
    least = known.counts.min(initial=0) if len(known.keys) == FREQUENT else 0
    wide = np.concatenate([known.counts, [known.texts], np.full(len(keys), least)]) >= BUCKET // 16
    by = np.where(w >= rare, mix[w], np.where(wide[h], _mixed(mix[h] + mix[w]), mix[h]))
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    bucket, h, w, d = _sorted((bucket, h, w, d), (buckets, len(key_of), len(key_of), len(ids)))
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rows, code = [], np.arange(len(key_of), dtype=np.int32)
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False):
        met = np.zeros(len(ids), dtype=bool)
        met[d[x:y]] = True
        far = np.unique(np.concatenate([h[x:y][h[x:y] >= rare], w[x:y][w[x:y] >= rare]]))
        code[far] = rare + np.arange(len(far))  # rare words by their order in the bucket
        rows.append((bucket[x], _pack([ids[met], tags[met], train[met], key_of[far], np.diff(code[h[x:y]], prepend=0), code[w[x:y]], (np.cumsum(met) - 1)[d[x:y]]])))
    settled = pd.concat(out)
    settled["bucket"] = (settled["tag"] + settled["doc_id"] % buckets) % buckets
    packed = _frame("bigrams", doc_id=np.zeros(len(rows), np.int64), payload=[r[1] for r in rows])
    packed["bucket"] = np.array([r[0] for r in rows], np.int64)
    return pd.concat([settled, packed])


def _meet(known: Known, payloads: list[bytes]) -> Iterator[pd.DataFrame]:
    """A bucket's bigrams: counted, settled for their texts, summed by history, and listed with their training counts."""
    fixed = len(known.keys)
    ids, tags, train, far, h, w, d = [], [], [], [], [], [], []
    texts, extra, ends, text_ends = 0, 0, [0], [0]
    for data in payloads:
        i, t, on, keys, steps, ws, ds = _unpack(data)
        hs = np.cumsum(steps, dtype=np.int32)
        shift = lambda c: np.where(c > fixed, c + np.int32(extra), c).astype(np.int32)  # noqa: B023, E731  # rare codes follow those of the parts before
        for list_, x in ((ids, i), (tags, t), (train, on), (far, keys), (h, shift(hs)), (w, shift(ws)), (d, (ds + np.int32(texts)).astype(np.int32))):
            list_.append(x)
        texts, extra = texts + len(i), extra + len(keys)
        ends.append(ends[-1] + len(ds))
        text_ends.append(texts)
    ids, tags, train, far, h, w, d = (np.concatenate(x) for x in (ids, tags, train, far, h, w, d))
    # Rare words of several parts get one code each.
    own_keys, place = np.unique(far, return_inverse=True)
    code = np.concatenate([np.arange(fixed + 1), fixed + 1 + place]).astype(np.int32)
    key_of = np.concatenate([known.keys, [START], own_keys])
    h, w = code[h], code[w]
    pair, inv = np.unique(h.astype(np.int64) << 32 | w, return_inverse=True)
    inv = inv.astype(np.int32)
    c2 = np.bincount(inv, train[d], len(pair)).astype(np.int64)
    pair_h, pair_w = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
    rare_w = w > fixed  # a rare word's occurrences are all here
    own = np.bincount(w[rare_w] - fixed - 1, train[d[rare_w]], len(own_keys)).astype(np.int64)
    count_of = np.concatenate([known.counts, [0], own]).astype(np.int64)
    seen = c2 > 0
    yield _histories(key_of[pair_h[seen]], c2[seen], known.p1(count_of[pair_w[seen]]))
    yield _frame("counts", h=key_of[pair_h[seen]], n=key_of[pair_w[seen]], known=c2[seen])
    at, text_at = 0, 0
    for end, text_end in zip(ends[1:], text_ends[1:], strict=True):  # frames of some parts, whose texts are apart: only these texts' sums are held
        if end - at < SETTLED and end < ends[-1]:
            continue
        x, t, at, text_at = slice(at, end), slice(text_at, text_end), end, text_end
        hc = np.where(h[x] <= fixed, h[x], -1)
        yield _settle(known, ids[t], tags[t], train[t], d[x] - t.start, key_of[h[x]], hc, count_of[w[x]], c2[inv[x]], rare_w[x])


@dataclass
class Model:
    """Tables of a fitted model: unigrams (w, c), bigrams (h, w, c) and histories (h, c, alpha), and the discounts. Words are 64-bit keys.

    ``texts`` has what the texts it was fitted with need to be scored without another lookup.
    """

    unigrams: DataFrame
    bigrams: DataFrame
    histories: DataFrame
    known: Known
    d2: np.ndarray
    texts: DataFrame


def katz_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base-10 log probabilities of whole texts under a Katz bigram model of the texts that aren't held out.

    P(w | h) = d c(hw) / c(h) if c(hw) > 0, else alpha(h) P(w); P(w) = d c(w) / N if c(w) > 0, else what is left, for
    the one unknown type. d is Good-Turing's for counts up to K; larger counts give up TRUST of a count, so each
    history leaves something to back off with. alpha(h) = (1 - sum of d c(hw) / c(h)) / (1 - sum of P(w)), over
    the w seen after h: all distributions over the training types and the unknown one sum to 1.

    The order is two. Returns per input row: the id, ``held_out``, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``, ``base_score``
    (add-one unigrams) and ``score``. Null and empty texts are an end alone. A null held_out is false. Rows alike in
    id and text are scored alike. Without training texts all mass is on the unknown type: scores are 0.
    """
    with arrow_rows(docs.sparkSession, 1000):
        model = fit(docs, held_out, id_col, text_col)
    return score(model, id_col)


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model's tables; the same pass gives each text's sums (Model.texts) for score()."""
    spark = docs.sparkSession
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        text_of(text_col).cast("binary").alias("text"),
    )
    # Only texts whose id repeats need a tag beside it.
    repeated = stored(base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "katz-repeated")
    base = flagged(base, repeated, ["doc_id"], "again").select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("tag"), "held", "text")
    train = base.where("not held").select("text", F.xxhash64("doc_id", "text").alias("at"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], most=1 << 20):
                keys, place, _ = _tokens(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(place, minlength=len(keys)))], names=["w", "c"])

    # Hot words are picked from about a hundredth of the texts: which words are hot changes no result, only where their bigrams are counted.
    some = train.where(F.pmod("at", F.lit(100)) == 0).mapInArrow(words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    hot_keys = np.unique(np.array([END, *(r[0] for r in some.orderBy(F.desc("c"), "w").limit(HOT).collect())], dtype=np.int64))
    size = len(hot_keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((size + 1) * size, dtype=np.int64)
        for batch in batches:
            for part in slices([batch], most=1 << 20):
                keys, place, d = _tokens(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(np.bincount(place, minlength=len(keys)))], names=["h", "w", "c"])
                at = np.minimum(np.searchsorted(hot_keys, keys), size - 1)
                w = np.where(hot_keys[at] == keys, at, -1)[place]
                first = np.append(True, d[1:] != d[:-1])
                h = np.where(first, 0, np.append(0, w[:-1] + 1))  # 0: START, or a word that isn't hot
                ok = (w >= 0) & (first | (h > 0))
                pairs += np.bincount(h[ok] * size + w[ok], minlength=len(pairs))
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.nulls(len(used), pa.int64()), pa.array(pairs[used])], names=["h", "w", "c"])

    counted = stored(train.mapInArrow(count, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c")), "katz-unigrams")
    unigrams = counted.where("w is not null").select("w", "c")
    tokens, types, texts = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("w") == END, F.col("c"))), F.lit(0))).first()
    by_count = {r[0]: r[1] for r in unigrams.where(F.col("c") <= K + 1).groupBy("c").count().collect()}
    hot = F.broadcast(spark.createDataFrame(pd.DataFrame({"w": hot_keys})))
    top = unigrams.orderBy(F.desc("c"), "w").limit(FREQUENT).unionByName(unigrams.join(hot, "w", "left_semi")).distinct().orderBy("w").toArrow()
    keys, counts = top.column("w").to_numpy(), top.column("c").to_numpy()
    d1 = good_turing(by_count)
    free = 1 - sum(d1[r - 1] * r * by_count.get(r, 0) for r in range(1, K + 1)) / max(tokens, 1) - (tokens - sum(r * by_count.get(r, 0) for r in range(1, K + 1))) / max(tokens, 1)
    pairs = np.zeros((size + 1) * size, dtype=np.int64)
    for r in counted.where("w is null").select("h", "c").toLocalIterator():  # HOT squared at most
        pairs[r[0]] = r[1]
    # Where no count is discounted, half a count is taken from all words for the unknown type.
    scale = 1.0 if free > 1e-12 else 1 - 0.5 / (tokens + 1)
    known = Known(keys, counts, tokens, types, texts, d1, free if free > 1e-12 else 1 - scale, scale, np.flatnonzero(np.isin(keys, hot_keys)), pairs.reshape(size + 1, size))
    if not tokens:
        known.hot, known.free = known.hot[:0], 1.0

    # One bucket takes about BUCKET of the corpus's tokens.
    share = base.agg(F.count_if("held"), F.count("*")).first()
    buckets = int(max(BUCKETS, -(-(tokens * share[1] // max(share[1] - share[0], 1) or share[1] * 1000) // BUCKET)))
    shared = spark.sparkContext.broadcast(known)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for part in _batches(pdf, PART):
                yield _deal(shared.value, buckets, part)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: packed ones are held until their bucket ends, settled ones pass."""

        def ended(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            for pdf in _meet(shared.value, held) if held else ():
                yield from _arrays(pdf)

        at, held = None, []
        for batch in batches:
            is_packed = pc.equal(batch.column("kind"), "bigrams")
            rest = batch.filter(pc.invert(is_packed))
            if rest.num_rows:
                yield from _arrays(rest.to_pandas())
            packed = batch.filter(is_packed)
            for b, data in zip(packed.column("bucket").to_pylist(), packed.column("payload").to_pylist(), strict=True):
                if b != at:
                    yield from ended(held)
                    at, held = b, []
                held.append(data)
        yield from ended(held)

    dealt = base.mapInPandas(deal, _OUT + ", bucket long").repartition("bucket").sortWithinPartitions("bucket")
    # A writer for each kind spares a sort.
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": len(_USED)}):
        met = stored(dealt.mapInArrow(meet, _ARRAYS), "katz-bigrams", "kind", **{"parquet.block.size": str(16 << 20)})
    r, c = np.nonzero(known.hot_counts)
    hot_hist = _histories(np.append(START, hot_keys)[r], known.hot_counts[r, c], known.p1(_counts_of(known, hot_keys)[c]))
    hist = _rows(met, "history")
    if len(hot_hist):
        hist = hist.unionByName(spark.createDataFrame(hot_hist[["h", "n", "known", *_KS, "x", "y"]]))
    hist = stored(hist.groupBy("h").agg(*[F.sum(k).alias(k) for k in ("n", "known", *_KS, "x", "y")]), "katz-history-sums")
    n = hist.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in (*_KS, "y")]).first()
    d2 = good_turing({r: int(n[r - 1]) for r in range(1, K + 2)})
    plain = sum((r * F.col(f"k{r}") for r in range(1, K + 1)), F.col("known"))
    kept = sum((float(r * d2[r - 1]) * F.col(f"k{r}") for r in range(1, K + 1)), F.col("known") - TRUST * F.col("n"))
    histories = hist.select("h", plain.alias("c"), ((1 - kept / plain) / (1 - F.col("x"))).alias("alpha"), F.pmod("h", F.lit(FOLDERS)).alias("folder"))
    histories = stored(histories, "katz-histories", "folder").drop("folder")
    bigrams = _rows(met, "counts").select("h", F.col("n").alias("w"), F.col("known").alias("c"))
    if len(r):  # HOT squared rows at most
        bigrams = bigrams.unionByName(spark.createDataFrame(pd.DataFrame({"h": np.append(START, hot_keys)[r], "w": hot_keys[c], "c": known.hot_counts[r, c]})))
    return Model(unigrams, bigrams, histories, known, d2, met)


def _counts_of(known: Known, keys: np.ndarray) -> np.ndarray:
    at = known.codes(keys)
    return np.where(at >= 0, np.append(known.counts, 0)[at], 0)


def score(model: Model, id_col: str = "doc_id") -> DataFrame:
    """Scores of the texts that the model was fitted with: their sums, with discounts and the backing off joined in."""
    rows, known = model.texts, model.known
    text = ["doc_id", "tag"]
    # log10 alpha(h) of each token that backs off; a rare history's count for those that don't.
    asked = _rows(rows, "back").join(model.histories, "h", "left")
    backed = asked.select(*text, (F.col("n") * F.log10(F.coalesce("alpha", F.lit(1.0))) - F.col("known") * F.log10(F.coalesce("c", F.lit(1)))).alias("x"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n", "known", "held", "copies")]
    discounts = sum((F.col(f"k{r}") * float(np.log10(model.d2[r - 1])) for r in range(1, K + 1)), F.col("x"))
    sums = (
        _rows(rows, "text").select(*text, discounts.alias("x"), "y", zero[0], "known", *zero[2:])
        .unionByName(backed.select(*text, "x", F.lit(0.0).alias("y"), *zero))
        .unionByName(_rows(rows, "row").select(*text, F.lit(0.0).alias("x"), "y", F.col("k1").alias("n"), F.col("k2").alias("known"), F.col("n").alias("held"), F.col("known").alias("copies")))
        .groupBy(*text)
        .agg(*[F.sum(c).alias(c) for c in ("x", "y", "n", "known", "held", "copies")])
    )
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    per = lambda c: F.col(c) / F.col("copies")
    tokens = (per("n")).cast("long")
    return each.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias(id_col),
        (F.col("held") > 0).alias("held_out"),
        tokens.alias("n_tokens"),
        per("known").cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (per("y") - tokens * float(np.log10(known.tokens + known.types + 1))).alias("base_score"),
        per("x").alias("score"),
    )


def score_texts(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of any texts: the id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``, from the model's tables alone.

    Each token's bigram is looked up; one that isn't there takes its history's weight (1 for an unknown history)
    times its word's probability. Rows as in katz_scores.
    """
    known, ids = model.known, docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).cast("binary").alias("text"))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            keys, place, d = _tokens(batch.column(2))
            w = keys[place]
            h = np.append(START, w[:-1])
            h[np.append(True, d[1:] != d[:-1])] = START
            cols = [batch.column(0).take(pa.array(d)), batch.column(1).take(pa.array(d)), pa.array(h), pa.array(w)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tag", "h", "w"])

    asked = ids.dropDuplicates(["doc_id", "tag"]).mapInArrow(bigrams, "doc_id long, tag long, h long, w long").groupBy("doc_id", "tag", "h", "w").agg(F.count("*").alias("n"))
    found = asked.join(model.bigrams.withColumnRenamed("c", "c2"), ["h", "w"], "left").join(model.histories.withColumnRenamed("c", "ch"), "h", "left").join(model.unigrams.withColumnRenamed("c", "c1"), "w", "left")
    cut = lambda c, d: F.coalesce(*[F.when(c == r, float(d[r - 1] * r)) for r in range(1, K + 1)])
    c1, c2 = F.col("c1"), F.col("c2")
    p1 = F.when(c1.isNull(), known.free).otherwise(known.scale * F.coalesce(cut(c1, known.d1), c1.cast("double")) / max(known.tokens, 1))
    p2 = F.coalesce(cut(c2, model.d2), c2 - TRUST) / F.col("ch")
    token = F.when(c2.isNotNull(), F.log10(p2)).otherwise(F.log10(F.coalesce("alpha", F.lit(1.0))) + F.log10(p1))
    base = F.log10(F.coalesce(c1, F.lit(0)) + 1.0) - float(np.log10(known.tokens + known.types + 1))
    sums = found.groupBy("doc_id", "tag").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(c1.isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.col("n") * base).alias("base_score"), F.sum(F.col("n") * token).alias("score"))
    return ids.select("doc_id", "tag").join(sums, ["doc_id", "tag"]).select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias(id_col), "n_tokens", "n_known", "base_score", "score")
