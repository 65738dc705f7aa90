"""Counterfactual-regularised toxicity classifier on words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, stored, text_of

#: Identity terms and their counterparts, swapped both ways.
IDENTITY_PAIRS = (
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("father", "mother"), ("son", "daughter"),
    ("husband", "wife"), ("gay", "straight"), ("lesbian", "heterosexual"), ("black", "white"), ("african", "european"),
    ("muslim", "christian"), ("jewish", "buddhist"), ("old", "young"), ("immigrant", "native"), ("disabled", "abled"),
    ("homme", "femme"), ("garçon", "fille"), ("noir", "blanc"), ("musulman", "chrétien"), ("hombre", "mujer"),
    ("chico", "chica"), ("negro", "blanco"), ("musulmán", "cristiano"), ("mann", "frau"), ("junge", "mädchen"),
    ("schwarz", "weiß"), ("moslem", "christ"),
)
SWAP: dict[bytes, bytes] = {a.encode(): b.encode() for x, y in IDENTITY_PAIRS for a, b in ((x, y), (y, x))}
PREFIXES = (4, 5, 6)


def features(words: Iterable[bytes]) -> set[bytes]:
    """Distinct words, and beginnings of 4 to 6 bytes (marked with a star) of longer ones: many insults are inflected."""
    words = set(words)
    return words | {w[:k] + b"*" for w in words for k in PREFIXES if len(w) > k}


def swapped(words: Iterable[bytes]) -> list[bytes]:
    return [SWAP.get(w, w) for w in words]


@dataclass
class Model:
    vocabulary: list[bytes]
    weights: np.ndarray
    bias: float
    place: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.vocabulary)}
        self.whole = {w: float(x) for w, x in zip(self.vocabulary, self.weights, strict=True) if not w.endswith(b"*")}
        self.begin = {w[:-1]: float(x) for w, x in zip(self.vocabulary, self.weights, strict=True) if w.endswith(b"*")}

    def score(self, text: bytes) -> float:
        words = set(alnum_words(text))
        z = self.bias + sum(sorted(self.whole[w] for w in words & self.whole.keys()))
        begins = {w[:k] for k in PREFIXES for w in words if len(w) > k}
        z += sum(sorted(self.begin[w] for w in begins & self.begin.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], vocabulary: list[bytes], gap: float = 1.0, ridge: float = 1.0, steps: int = 400, rate: float = 0.1) -> Model:
    """Logistic regression by Adam on rows (features, features after the swap, label).

    The loss is the mean log loss + gap * mean((z(text) - z(swapped text))^2) over texts that the swap
    changes + ridge / 2n * |w|^2. Both extra terms pull on weights only, not on the bias.
    """
    n, v = len(rows), len(vocabulary)
    y = np.array([r[2] for r in rows], dtype=float)
    size = [len(r[0]) for r in rows]
    cols = np.concatenate([r[0] for r in rows]) if n else np.zeros(0, int)
    at = np.repeat(np.arange(n), size)
    changed = [i for i, r in enumerate(rows) if len(r[0]) != len(r[1]) or not np.array_equal(r[0], r[1])]
    d_at = np.concatenate([np.full(len(rows[i][0]) + len(rows[i][1]), k) for k, i in enumerate(changed)]) if changed else np.zeros(0, int)
    d_cols = np.concatenate([np.concatenate(rows[i][:2]) for i in changed]) if changed else np.zeros(0, int)
    d_sign = np.concatenate([np.repeat([1.0, -1.0], [len(rows[i][0]), len(rows[i][1])]) for i in changed]) if changed else np.zeros(0)
    w = np.zeros(v + 1)
    if n and 0 < y.mean() < 1:
        w[v] = np.log(y.mean() / (1 - y.mean()))
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for t in range(1, (steps if n and 0 < y.mean() < 1 else 0) + 1):
        z = w[v] + np.bincount(at, w[cols], n)
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.append(np.bincount(cols, err[at], v), err.sum())
        if changed:
            dz = np.bincount(d_at, d_sign * w[d_cols], len(changed))
            g[:v] += 2 * gap / len(changed) * np.bincount(d_cols, d_sign * dz[d_at], v)
        g[:v] += ridge / n * w[:v]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Model(vocabulary, w[:v], float(w[v]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_rows: int = 30_000, vocabulary: int = 4096, least_g2: float = 12.0, gap: float = 1.0) -> Model:
    """Fit on a bounded sample of labelled rows: all of them, up to about ``sample_rows``.

    Which rows is decided by the hash of their ids, on the labels table, so the sample's ids can be
    broadcast (a few hundred kB at most) and the documents aren't shuffled. Words' document counts per label are made by
    Spark over the sample; the ``vocabulary`` features with the largest G2 statistic, of ``least_g2`` at least,
    and all identity terms are what the model may use. Texts are used whole, null ones as empty. Rows that repeat an id are
    all used, each with all of the id's labels: ids with both labels count once for each, rows of labels that repeat count once. Other
    columns of docs and labels are never read. Null labels, ids and labels other than 0 and 1 are left out; without both
    labels the model is a constant, the share of positives (a half for no rows at all).
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    share = sample_rows / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    some = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).join(F.broadcast(marked), "id")
    rows = stored(some.select("text", "label"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in features(alnum_words(text)):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "n0", "n1"])

    total = rows.agg(F.count("*"), F.sum("label")).first()
    n, n1 = total[0], total[1] or 0
    if not n or n1 in (0, n):
        return Model([], np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    a, b = F.col("n1"), F.col("n0")
    expect = (a + b) / n
    cell = lambda seen, mean: F.when(seen > 0, seen * F.log(seen / mean)).otherwise(0.0)
    g2 = 2 * (cell(a, expect * n1) + cell(b, expect * (n - n1)) + cell(n1 - a, (1 - expect) * n1) + cell((n - n1) - b, (1 - expect) * (n - n1)))
    counts = rows.mapInArrow(count, "feature binary, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(a + b > 1)
    best = [bytes(r[0]) for r in counts.where(g2 >= least_g2).orderBy(F.round(g2, 6).desc(), "feature").limit(vocabulary).select("feature").collect()]
    terms = sorted(set(SWAP) - set(best))
    vocab = best + terms
    place = {w: i for i, w in enumerate(vocab)}

    def ids(words: list[bytes]) -> list[int]:
        return sorted(place[f] for f in features(words) & place.keys())

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [alnum_words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(ids(w), "<i4").tobytes() for w in words], pa.binary()), pa.array([np.array(ids(swapped(w)), "<i4").tobytes() for w in words], pa.binary()), batch.column(1)], names=["x", "x2", "label"])

    sample = rows.mapInArrow(to_ids, "x binary, x2 binary, label int").collect()
    sample = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in sample)
    return fit([(np.frombuffer(x, "<i4"), np.frombuffer(x2, "<i4"), y) for x, x2, y in sample], vocab, gap)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the model's score of each whole text, however long; null and empty texts score as the bias says.

    Rows alike in text score alike. A column that is already called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype=float)

    return docs.withColumn(out, run(text_of(text_col).cast("binary")))
