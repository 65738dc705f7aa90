"""Prefix trie, hard negatives and nearest neighbours against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import art, hardneg, kmtree, queries, trie


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, trie_id(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    found = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        found[c] = own.get(base, [])[:h] + x[h:]
    return found


def trie_id(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("chunk", F.lit(1))


def test_radix_tree_layouts():
    keys = sorted({bytes([a, b, 7, 7]) for a in range(0, 256, 3) for b in (0, 255)} | {bytes([5, b]) for b in range(50)} | {b"", bytes([3])})
    tree = art.Tree(keys)
    for i in random.Random(1).sample(range(len(keys)), len(keys)):
        tree.insert(i)
    assert sorted(n.end for n, _ in tree.walk() if n.end >= 0) == list(range(len(keys)))
    for i, k in enumerate(keys):
        assert list(tree.path(k))[-1].end == i
    assert isinstance(tree.root.layout, art.Full)
    assert isinstance(tree.root.layout.find(5).layout, art.Full)  # 50 children
    assert isinstance(tree.root.layout.find(6).layout, art.Small)
    with pytest.raises(ValueError):
        tree.insert(0)


@pytest.mark.parametrize("band,keys", [(512, 1 << 14), (4, 8), (3, 1)])
def test_trie_on_made_up_conversations(spark, band, keys):
    rnd = random.Random(band)
    rows = []
    for c in [*range(150), 200, 205, 305, 2**40, -3]:
        for t in range(rnd.choice([1, 1, 2, 3, 7, 12])):
            rows.append((c, t, rnd.choice(["user", None]), rnd.choice(["a", "bb", "", None, "ünï"])))
    rows += [(399, None, "user", "a"), (399, 3, "x", "y"), (399, 3, "x", "z"), (399, 3, "x", "z"), (None, 1, "user", "lost"), (400, 0, "long", "word " * 50000)]
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 560) for t in range(9)]
    df = conversations(spark, rows).repartition(5)
    turns = trie.with_borrowed_heads(trie.numbered_turns(df), F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6, 5, F.col("conv_id") % 100 == 0)
    got = sorted((tuple(r) for r in trie.prefix_trie(turns, band, keys).collect()), key=repr)
    assert got == brute_trie(rebuilt(rows))


def test_trie_of_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (1, 2, 3) for t in range(40)] + [(3, 40, "user", "more"), (4, 0, "user", "0")]
    got = sorted((tuple(r) for r in trie.prefix_trie(trie.numbered_turns(conversations(spark, rows)), 8, 2).collect()), key=repr)
    convs = {c: [(r, x) for cc, _, r, x in rows if cc == c] for c in (1, 2, 3, 4)}
    assert got == brute_trie(convs)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(trie.numbered_turns(conversations(spark, []))).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("leaf", F.lit(1))


def made_up(seed, n, dim):
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in g.normal(size=dim).astype(np.float32)], int(g.integers(3))) for i in range(n)]
    rows += [(1000 + i, rows[7][1], int(g.integers(3))) for i in range(60)]  # one vector, many ids
    return rows


ODD = [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan"), 1.0], 0), (2300, [float("inf")] * 12, 0), (2400, [], 0), (2500, [1.0, 2.0, 3.0], 1), (2501, [1.0, 2.0, 2.5], 1), (2502, [2.0, 2.0, 2.0], 2), (None, [1.0] * 12, 1), (2600, [0.0] * 12, 0)]


def brute_negatives(rows):
    import math

    ok = [(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, ya in sorted(set(ok)):
        if a % 100:
            continue
        s = [(-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in ok if i != a and len(v) == len(va)]
        for p, pid, _ in sorted(x for x in s if x[2] == ya)[:5]:
            low = [x for x in sorted(s) if x[2] != ya and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(a, pid, r + 1, n, -p, -x) for r, (x, n, _) in enumerate(low[:10])]
    return sorted(out)


def test_hard_negatives(spark):
    rows = made_up(1, 400, 12) + ODD + [(3000, [30000.0, -70000.0, *[0.25] * 10], 1), (3001, [30000.0, 70000.0, *[0.25] * 10], 1), (3002, [15000.0, 1000.0, *[0.25] * 10], 2), (50, [1.0] * 12, None)]
    got = sorted(tuple(r) for r in hardneg.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_negatives(rows) and len(got) > 50


def test_hard_negatives_in_many_blocks_and_of_nothing(spark, monkeypatch):
    rows = made_up(2, 350, 9)
    monkeypatch.setattr(hardneg, "ANCHORS_A_BLOCK", 1)
    assert sorted(tuple(r) for r in hardneg.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()) == brute_negatives(rows)
    assert hardneg.mine(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 45, 1 << 62])
def test_subset_sums_give_the_inner_product(size):
    g = np.random.default_rng(size % 97)
    a, c = g.integers(-size, size + 1, (5, 19)), g.integers(-size, size + 1, (40, 19))
    packed = hardneg.bit_planes(c)
    table = hardneg.SubsetSums(a)
    for row, p in zip(c, packed):
        got = table.scores(np.frombuffer(p, np.uint8).reshape(1, -1, 3))[0]
        assert (got == (a * row).sum(axis=1)).all()  # both wrap alike


def test_neighbours_with_all_leaves_are_exact(spark):
    rows = made_up(3, 600, 12) + ODD + [(20, [9.0] * 12, 1)]
    got = {}
    for r in kmtree.ann(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    ok = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    hit = total = 0
    seen = set()
    for q, v in ok:
        if q % 20 or q in seen:
            continue
        seen.add(q)
        best = sorted((-float(np.dot(np.array(v), np.array(w))), i) for i, w in ok if i != q and len(w) == len(v))[:20]
        want = [(r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(best)]
        assert len(got.get(q, [])) == len(want), q
        hit, total = hit + len(set(want) & set(got.get(q, []))), total + len(want)
    assert set(got) == {q for q in seen} and hit / total > 0.99


def test_neighbours_reach_the_recall(spark):
    from tests.conftest import SF

    e, report = spark.read.parquet(f"{SF}/embeddings.parquet"), []
    found = kmtree.ann(e, F.col("vec_id") % 20 == 0, report=report)
    assert kmtree.measured_recall(found, e, F.col("vec_id") % 20 == 0) >= 0.9
    (_, leaves, visits, reached), = report
    assert visits < leaves and reached >= 0.95
    assert kmtree.ann(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_new_queries_run(spark):
    from tests.conftest import SF

    assert queries.op13_nearest_neighbours(spark, SF).columns == ["query_id", "rank", "vec_id", "score"]
