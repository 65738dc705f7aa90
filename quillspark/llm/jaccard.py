"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

Links of equal sets are found by a digest of the set, so the join proper runs between distinct sets
(nodes), in two levels. The first orders shingles by a small sketch of their frequency; pairs come from
prefix members that few nodes hold. Nodes that hold a member of many go through the second, where the
order is by exact counts. Results are the connected components of all links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, flagged, slices, stored, text_of, white_words

#: Counters of the frequency sketch: fixed size, 2 MB when broadcast.
SKETCH = 1 << 18
#: Stands for a null id: larger than others, so it names a component only where there is no other.
_NO_ID = (1 << 63) - 1
#: Buckets of up to so many nodes give pairs; of larger ones, nodes not linked to the bucket's first are cut into chunks of about so many nodes or set members.
SMALL, CHUNK_NODES, CHUNK_MEMBERS = 64, 256, 200_000
_NODE = ["doc_id", "tag"]
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, computed once per distinct word."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words are one shingle, none give an empty set."""
    split = [white_words(t) for t in texts]
    hashes = hash_words([w for ws in split for w in ws])
    out, at = [], 0
    for ws in split:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        n = max(1, len(h) - k + 1) if len(h) else 0
        s = np.full(n, len(h) if len(h) < k else k, dtype=np.uint64)
        for i in range(min(k, len(h))):
            s = _mixed(s * _MIX[0] + h[i : i + n])
        out.append(np.unique(s))
    return out


def _digest(members: np.ndarray) -> bytes:
    return blake2b(members.tobytes(), digest_size=16).digest()


def _ranked(members: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set as sorted keys in the global order: the sketch's class in the top 12 bits, the hash's low 52 bits below."""
    keys = (rank[(members >> np.uint64(46)).astype(np.int64)] << np.uint64(52)) | (members & np.uint64((1 << 52) - 1))
    return np.sort(keys)


def prefix_length(n: int, share: int) -> int:
    """A set of n members with a link of at least share percent has a common member among its first so many."""
    return n - -(-share * n // 100) + 1


def overlap_needed(a: int, b: int, share: int) -> int:
    """The least intersection of linked sets of sizes a and b: 100 i >= share (a + b - i)."""
    return -(-share * (a + b) // (100 + share))


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many common members of two sorted arrays: cut at the middle of y, members can only meet on their side."""
    if not len(x) or not len(y):
        return 0
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    return min(cut, mid) + min(len(x) - cut, len(y) - mid)


def linked(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    need = overlap_needed(len(x), len(y), share)
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each end of the edges (a, b) reaches, by large-star and small-star rounds."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("m", "a").alias("m"))
        large = both.join(low, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(low, F.col("a") == F.col("v")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = stored(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


class Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        self.of[self.of == max(x, y)] = min(x, y)


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose (doc_id, tag) is among the keys, and a few more, which exact joins drop later."""
    return flagged(rows, keys, _NODE, "_marked").where("_marked").drop("_marked")


def _within(share: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that connect two chunks of one bucket. A pair is left to the bucket of its first common prefix member."""
        pdf = pdf.sort_values(["n", "node"])
        sets = list(pdf["members"])
        pos, n, chunk, (_, i, j) = pdf["pos"].to_numpy(), pdf["n"].to_numpy(), pdf["chunk"].to_numpy(), key
        before = [set(p[:k].tolist()) for p, k in zip(pdf["prefix"], pdf["place"], strict=True)]
        forest, out = Forest(len(sets)), []
        for a in range(len(sets)):
            # Shorter sets come first: the length filter bounds how far back a partner may be.
            back = np.arange(int(np.searchsorted(n, -(-share * n[a] // 100))), a)
            back = back[chunk[back] != chunk[a]] if i != j else back
            need = -(-share * (n[a] + n[back]) // (100 + share))
            back = back[np.minimum(n[a] - pos[a], n[back] - pos[back]) >= need]  # positional filter
            back = back[forest.of[back] != forest.of[a]]
            for b in back:
                if forest.of[a] != forest.of[b] and before[a].isdisjoint(before[b]) and linked(sets[a], sets[b], share):
                    forest.join(a, b)
                    out.append((a, b))
        ids = pdf["node"].to_numpy()
        x, y = (np.array([p[k] for p in out], dtype=int) for k in (0, 1))
        return pd.DataFrame({"a": ids[x], "b": ids[y]})

    return run


def _bucket_pairs(held: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes that meet in buckets of up to SMALL of held (gram, node, n, pos, m), each pair once: those that pass
    the length filter, in some bucket the positional one, and of which the common members can be enough."""
    large = held.groupBy("node").agg(F.count_if(F.col("m") > SMALL).alias("large"))
    small = held.where(F.col("m") <= SMALL).join(large, "node")
    ordered = small.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("n", "node", "pos", "large"))).alias("es"))
    need = lambda x, y: F.ceil(share * (x + y) / (100 + share))
    near = lambda x, y: 100 * x["n"] >= share * y["n"]
    fits = lambda x, y: (F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= need(x["n"], y["n"]))
    later = lambda x, i: F.slice(F.col("es"), i + 2, F.size("es"))
    pair = lambda x, y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("a_n"), y["n"].alias("b_n"), F.least(x["large"], y["large"]).alias("large"), fits(x, y).alias("fits"))
    each = F.transform("es", lambda x, i: F.transform(F.filter(later(x, i), lambda y: near(x, y)), lambda y: pair(x, y)))
    pairs = ordered.select(F.explode(F.flatten(each)).alias("p")).select("p.*").groupBy("a", "b", "a_n", "b_n", "large").agg(F.count("*").alias("c"), F.bool_or("fits").alias("fits")).where("fits")
    # Of the two prefixes one ends first; all members it leaves may be common, and in the prefixes those counted here or in large buckets.
    rest = lambda n: F.ceil(share * F.col(n) / 100) - 1
    return pairs.where(F.col("c") + F.col("large") + F.greatest(rest("a_n"), rest("b_n")) >= need(F.col("a_n"), F.col("b_n"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose sets (node, members) link."""

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(a, b, share) for a, b in zip(x, y, strict=True)], dtype=bool)

    side = lambda s: sets.select(F.col("node").alias(s), F.col("members").alias(f"{s}_members"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(check("a_members", "b_members")).select("a", "b")


def _exact_prefixes(sets: DataFrame, share: int) -> DataFrame:
    """(node, n, prefix, skipped) of nodes by exact counts over these sets, rarest members first. Members of one
    set only, the first so many (skipped) in the order, can't be common; a prefix of nothing else links with nobody."""
    grams = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    repeated = grams.join(counts, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
    skipped = (F.col("n") - F.size("g")).alias("skipped")
    length = F.col("n") - F.ceil(share * F.col("n") / 100).cast("int") + 1
    return repeated.select("node", "n", skipped, F.transform(F.slice("g", F.lit(1), F.greatest(length - (F.col("n") - F.size("g")), F.lit(0))), lambda x: x["gram"]).alias("prefix")).where(F.size("prefix") > 0)


def _bucketed(entries: DataFrame) -> DataFrame:
    """entries (gram, n, ...) of grams that two or more nodes hold, with the bucket's number of nodes (m)."""
    return entries.join(entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "gram")


def _large_buckets(held: DataFrame, prefixes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links of nodes that meet in large buckets. Each node is first verified against the bucket's first node: nodes linked to
    it need no comparison among themselves. Those that aren't are compared, in chunk pairs of bounded size, with one
    another and with the others, and only links that connect are returned."""
    large = held.where(F.col("m") > SMALL)
    first = large.groupBy("gram").agg(F.min(F.struct("node", "n")).alias("first"))
    others = large.join(first, "gram").where("node <> first.node")
    near = 100 * F.least("n", "first.n") >= share * F.greatest("n", "first.n")
    star = others.where(near).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    star = stored(_verified(star, sets, share), "jaccard-star")
    same = star.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("joined"))
    flagged = others.withColumn("hub", F.col("first.node")).join(same, ["hub", "node"], "left").withColumn("apart", F.col("joined").isNull())
    chunks = lambda which: F.greatest(F.ceil(F.count_if(which) / CHUNK_NODES), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / CHUNK_MEMBERS)).cast("int")
    sizes = flagged.groupBy("gram").agg(chunks(F.col("apart")).alias("left"), chunks(~F.col("apart")).alias("right")).where("left > 0")
    # Chunks of nodes apart are numbered first; each of the others meets only these.
    own = F.pmod(F.xxhash64("node"), F.when(F.col("apart"), F.col("left")).otherwise(F.col("right"))).cast("int") + F.when(F.col("apart"), 0).otherwise(F.col("left"))
    partners = F.when(F.col("apart"), F.col("left") + F.col("right")).otherwise(F.col("left"))
    dealt = flagged.join(sizes, "gram").withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    whole = prefixes.select("node", "prefix").join(sets, "node")
    met = dealt.select("gram", "i", "j", "node", "n", "pos", "place", "chunk").join(whole, "node")
    found = met.groupBy("gram", "i", "j").applyInPandas(_within(share), "a long, b long")
    return star.unionByName(found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, share: int = 85) -> DataFrame:
    """Documents whose sets of word shingles link, directly or in a chain, when 100 * |A & B| >= share * |A | B|.

    One row per input row: the id, ``n_shingles``, ``component_id`` (smallest id reachable, itself included), ``set`` (a
    digest of the set; null sets don't occur), ``row_tag`` (a hash of the text) and ``component_tag`` (that of the row that
    stands for the component, under the id component_id). Null or empty texts have no
    shingles and are linked with nothing. Rows that repeat an id with other texts are separate nodes of that name; a
    component's name is null only if all ids in it are.

    The first level's order of shingles is by class of frequency in a sketch over all rows, rarest first, then by hash:
    any order gives the same links. Pairs whose common prefix members are all in buckets over SMALL nodes are
    pairs of nodes that hold such a member: these nodes' sets are counted exactly and joined again, by prefixes
    that begin with the rarest members. Buckets that stay large are mostly groups of near copies, and cost a
    comparison a node with the bucket's first one; the work grows with the square only in nodes of a bucket that
    don't link to it. Shingles are compared by 64 bits of hash.
    """
    with arrow_rows(docs.sparkSession, 1000):
        return _components(docs, id_col, text_col, words, share)


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, share: int) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).cast("binary").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in slices(batches, most=4 << 20):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            counts += np.bincount((np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([_digest(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32())], names=["doc_id", "tag", "n", "set", "counter"])
        used = np.flatnonzero(counts)
        empty = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(counts[used]), *empty, pa.array(used.astype(np.int32))], names=["doc_id", "tag", "n", "set", "counter"])

    described = stored(base.mapInArrow(describe, "doc_id long, tag long, n int, set binary, counter int"), "jaccard-sets")
    counts = np.zeros(SKETCH)
    for r in described.where("counter IS NOT NULL").groupBy("counter").agg(F.sum("doc_id")).collect():  # SKETCH rows at most
        counts[r[0]] = r[1]
    rank = spark.sparkContext.broadcast(np.minimum(128 * np.log2(counts + 1), 4095).astype(np.uint64))
    rows = described.where("counter IS NULL").drop("counter")
    # A distinct set is a node, with a number, and the smallest (id, tag) that has it.
    nodes = rows.where("n > 0").groupBy("set").agg(F.min(F.struct(*_NODE)).alias("x")).select("set", "x.*", F.monotonically_increasing_id().alias("node"))
    nodes = stored(nodes, "jaccard-nodes")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            grams = [_ranked(s, rank.value)[: prefix_length(len(s), share)].view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "tag", "n", "grams"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            sets = [np.sort(s.view(np.int64)) for s in shingle_sets(batch.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "tag", "members"])

    # Only nodes' sets are worked on; rows alike in id and text are one node.
    only = lambda df, keys, name: stored(df.join(keys.select(*_NODE, "node"), _NODE).dropDuplicates(_NODE).drop(*_NODE), name)
    near = only(marked(base, nodes).mapInArrow(prefixes, "doc_id long, tag long, n int, grams array<long>"), nodes, "jaccard-prefixes")
    held = stored(_bucketed(near.select("node", "n", F.posexplode("grams").alias("pos", "gram"))), "jaccard-buckets")
    pairs = stored(_bucket_pairs(held, share), "jaccard-pairs")
    crowded = stored(held.where(F.col("m") > SMALL).select("node").distinct(), "jaccard-crowded")
    asked = stored(nodes.join(crowded.unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "node", "left_semi"), "jaccard-asked")
    sets = only(marked(base, asked).mapInArrow(members, "doc_id long, tag long, members array<long>"), asked, "jaccard-members")

    exact = stored(_exact_prefixes(sets.join(crowded, "node", "left_semi"), share), "jaccard-exact")
    placed = exact.select("node", "n", "skipped", F.posexplode("prefix").alias("place", "gram")).withColumn("pos", F.col("skipped") + F.col("place"))
    again = stored(_bucketed(placed), "jaccard-exact-buckets")
    few = _verified(pairs.unionByName(_bucket_pairs(again, share)).distinct(), sets, share)
    many = _large_buckets(again, exact, sets, share)

    roots = components(few.unionByName(many)).withColumnRenamed("node", "number")
    placed = nodes.join(roots, nodes["node"] == roots["number"], "left").withColumn("root", F.coalesce("root", nodes["node"]))
    least = placed.groupBy("root").agg(F.min(F.struct(*_NODE)).alias("least")).withColumnRenamed("root", "_root")
    named = placed.join(least, F.col("root") == F.col("_root")).select("set", F.col("least.doc_id").alias("component_id"), F.col("least.tag").alias("component_tag"))
    real = lambda c: F.when(c != _NO_ID, c)
    return rows.join(named, "set", "left").select(
        real(F.col("doc_id")).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        real(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.col("set"),
        F.col("tag").alias("row_tag"),
        F.when(F.col("n") > 0, F.col("component_tag")).otherwise(F.col("tag")).alias("component_tag"),
    )
