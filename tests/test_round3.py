"""Edit paths, layout, ranks, boosting and the retry loop against plain rules."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import forecast, layout, quality, ranks, retry, review
from quillspark.plans import boosting, registry, verifier

from .conftest import SF


def plain_ops(a, b):
    """(s, d, i, c) by the whole table, from the end: match, else substitution, deletion, insertion."""
    t = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), [0, 0, 0, 0]
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and t[i - 1][j - 1] == t[i][j]:
            i, j, k = i - 1, j - 1, 3
        elif i and j and t[i - 1][j - 1] + 1 == t[i][j]:
            i, j, k = i - 1, j - 1, 0
        elif i and t[i - 1][j] + 1 == t[i][j]:
            i, k = i - 1, 1
        else:
            j, k = j - 1, 2
        out[k] += 1
    return tuple(out)


def test_edit_path_of_random_pairs():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé😀") for _ in range(rnd.randrange(n)))
    pairs = [(word(14), word(14)) for _ in range(600)] + [("", ""), ("", "abc"), ("abc", ""), ("abc", "bcd"), ("same", "same")]
    got = [tuple(r) for r in text._all_counts([(text._points(a), text._points(b)) for a, b in pairs]).tolist()]
    assert got == [plain_ops(a, b) for a, b in pairs]


def test_edit_path_of_very_long_texts_needs_little_memory():
    import tracemalloc

    a = "lorem ipsum dolor " * 1000
    b = a[:9000] + "X" + a[9001:]
    tracemalloc.start()
    got = text._all_counts([(text._points(a), text._points("Y" + b))])
    assert tuple(got[0]) == (1, 0, 1, 17999) and tracemalloc.get_traced_memory()[1] < 50 << 20  # a table would take a gigabyte
    tracemalloc.stop()


def test_normalized_cer(spark):
    pairs = [("abc", "bcd", 0.5), ("abc", "abc", 0.0), ("", "", 0.0), (None, "ab", 1.0), ("abcd", "abxd", 0.25), ("ab", "ba", 2 / 3)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in df.select("i", text.normalized_cer(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    s = plain_ops("ab", "ba")
    pairs[-1] = ("ab", "ba", sum(s[:3]) / sum(s))
    assert got == pytest.approx([x for _, _, x in pairs])


def test_rates_of_empty_references(spark):
    df = spark.createDataFrame([("local", "date", "", "abcd"), ("local", "date", None, "ab"), ("vlm", "date", "ab", "ab")], "tier string, field_name string, reference string, hypothesis string")
    got = {(r.tier, r.field_name): (r.cer, r.wer, r.norm_cer) for r in quality.error_rates(df).collect()}
    assert got["local", "date"] == (1.0, 1.0, 1.0) and got["vlm", None] == (0.0, 0.0, 0.0)


def test_words_part_at_all_white_space_and_many_words_are_counted(spark):
    many = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([("a b c", "a b　d"), (many, many + " x")], "a string, b string")
    assert [r[0] for r in df.select(text.word_edits(F.col("a"), F.col("b"))).collect()] == [1, 1]


BLOCK = "document_id string, page int, pos int, text string, score double, x1 double, y1 double, x2 double, y2 double"


def random_blocks(seed, n=40):
    rnd = random.Random(seed)
    texts = ["Total", "Subtotal", "Tax", "Invoice No:", "Date:", "Vendor:", "12.50", "$7.00", "INV-9", "Acme", "2024-01-02", "100.00"]
    out = []
    for i in range(n):
        x, y, w, h = rnd.uniform(0, 500), rnd.uniform(0, 300), rnd.uniform(10, 120), rnd.choice([8.0, 12.0, 40.0])
        out.append((f"d{rnd.randrange(3)}", rnd.randrange(2), i, rnd.choice(texts), 0.9, x, y, x + w, y + h))
    return out


def test_pairs_by_bands_equal_all_pairs(spark):
    rows = [r for seed in range(4) for r in [(f"{seed}{x[0]}", *x[1:]) for x in random_blocks(seed)]]
    df = spark.createDataFrame(rows, BLOCK)
    kinds = {r.text: (r.label, r.amount) for r in layout.classify_blocks(df).select("text", "label", "amount").distinct().collect()}
    want = {}
    for doc, page, pos, t, _, x1, y1, x2, y2 in rows:
        label = kinds[t][0]
        if label is None:
            continue
        h, w, money = max(y2 - y1, 1), max(x2 - x1, 1), label in ("total_amount", "subtotal", "tax")
        for doc2, page2, pos2, t2, _, u1, v1, u2, v2 in rows:
            if (doc2, page2) != (doc, page) or pos2 == pos or not (kinds[t2][1] is not None if money else kinds[t2][0] is None):
                continue
            dy, dx = abs((v1 + v2) / 2 - (y1 + y2) / 2), abs((u1 + u2) / 2 - (x1 + x2) / 2)
            wide = max(3 * w, 6 * h) if money else max(2 * w, 4 * h)
            if dy <= 0.9 * h and u1 >= x2 - 0.25 * w:
                want.setdefault((doc, page, pos), []).append((0, u1 - x2, pos2))
            elif v1 >= y2 - 0.225 * h and dx <= wide:
                want.setdefault((doc, page, pos), []).append((1, v1 - y2 + 0.25 * dx, pos2))
    got = {}
    for r in layout.pair_candidates(df).orderBy("rank").collect():
        got.setdefault((r.document_id, r.page, r.l_pos), []).append(r.v_pos)
    assert got == {k: [p for *_, p in sorted(v)] for k, v in want.items()} and len(got) > 20


def test_lines_of_uneven_pages(spark):
    rows = random_blocks(9, 80) + [("d9", None, 1, "alone", 0.9, 1.0, 2.0, 3.0, 4.0)]
    got = {(r.document_id, r.page): r.text for r in layout.reading_order(spark.createDataFrame(rows, BLOCK).repartition(3)).collect()}
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        page = [r for r in rows if (r[0], r[1]) == key]
        near = max(8.0, 0.6 * sum(max(r[8] - r[6], 1) for r in page) / len(page))
        lines, anchor = [], None
        for cy, x1, pos, t in sorted(((r[6] + r[8]) / 2, r[5], r[2], r[3]) for r in page):
            if anchor is None or abs(cy - anchor) > near:
                lines.append([])
                anchor = cy
            lines[-1].append((x1, pos, t))
        want[key] = "\n".join(" ".join(t for *_, t in sorted(line)) for line in lines)
    assert got == want


def test_triangles(spark):
    rnd, rows, want = random.Random(3), [], {}
    for d in range(120):
        values = [Decimal(rnd.randrange(1, 60)) / rnd.choice([1, 4, 100]) for _ in range(rnd.randrange(2, 9))]
        rows += [(f"d{d}", i, f"{v:.2f}") for i, v in enumerate(values)]
        distinct = sorted(set(values))
        hits = [(-t, -s, values.index(x), x) for t in distinct for s in distinct if s < t for x in distinct if x < t and abs(x - (t - s)) <= Decimal("0.02")]
        if len(distinct) >= 3 and hits:
            t, s, _, x = min(hits)
            want[f"d{d}"] = (-t, -s, x)
    rows += [("many", i, str(10**6 + 2**20 * i + i * i)) for i in range(2000)]
    got = {r.document_id: (r.total, r.subtotal, r.tax) for r in layout.triangulate(spark.createDataFrame(rows, "document_id string, pos int, value string")).collect()}
    got.pop("many", None)
    assert got == want and len(got) > 25


def test_ranks_of_one_large_group(spark):
    rnd = random.Random(2)
    values = [("hot", float(rnd.randrange(500))) for _ in range(4000)] + [(None, 1.5), (None, 2.5), ("one", 3.0), ("none", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(7)
    got = {r.g: (r.p50, r.p90) for r in ranks.counted(df, "v", "g").groupBy("g").agg(ranks.percentile("v", 0.5).alias("p50"), ranks.percentile("v", 0.9).alias("p90")).collect()}
    hot = [v for g, v in values if g == "hot"]
    assert got["hot"] == pytest.approx((np.percentile(hot, 50), np.percentile(hot, 90)))
    assert got[None] == pytest.approx((2.0, 2.4)) and got["one"] == (3.0, 3.0) and "none" not in got


NAMES = [f"f{i}" for i in range(5)]


def made_up(spark, n=3000):
    g = np.random.default_rng(4)
    x = np.round(g.normal(size=(n, 5)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0.2).astype(int)
    rows = [(int(a), 1.0 + i % 2, *map(float, r)) for i, (a, r) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "label int, weight double, " + ", ".join(f"{f} double" for f in NAMES)), x, y


def test_boosting_gathered_and_spread(spark, monkeypatch, tmp_path):
    df, x, y = made_up(spark)
    one = boosting.boosted(df, NAMES, rounds=6, leaves=8)
    monkeypatch.setattr(boosting, "ROWS_A_PART", 1000)
    monkeypatch.setattr(boosting, "ROUNDS_A_CHECKPOINT", 2)
    three = boosting.boosted(df, NAMES, rounds=6, leaves=8)
    assert np.allclose(one.margins(x), three.margins(x), atol=1e-6)
    for t in one.trees:
        leaf = boosting._leaf(t["feature"], t["threshold"], t["lower"], t["upper"], x)
        assert len(set(leaf)) <= 8 and min(np.bincount(leaf)[list(set(leaf))]) >= 5
    one.save(spark, f"{tmp_path}/m")
    again = boosting.Boosted.load(spark, f"{tmp_path}/m")
    assert np.allclose(again.margins(x), one.margins(x))
    shown = df.withColumn("p", one.probability(NAMES)).collect()
    assert np.allclose([r.p for r in shown], 1 / (1 + np.exp(-one.margins(np.array([[r[f] for f in NAMES] for r in shown])))))


def test_boosting_learns_and_takes_the_best_leaf_first(spark):
    df, x, y = made_up(spark)
    model = boosting.boosted(df, NAMES, rounds=60)
    order = np.argsort(np.argsort(model.margins(x)))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.98
    assert boosting.boosted(df.where("label = 1"), NAMES).trees == [] and boosting.boosted(df.limit(0), NAMES).trees == []


def test_verifier_reaches_its_floor(spark):
    """All rounds on the corrupted ledger; the figures are in the README."""
    card = registry._verifier(spark, SF)
    assert card.metrics["trees"] == 200 and card.metrics["auroc"] > 0.93 and card.metrics["f1"] > 0.85
    assert card.recalls["correction"] > 0.9 and set(card.recalls) <= {*verifier.OPERATORS, "correction"}
    scored = registry.QUERIES["m14_verifier_scores"](spark, SF)
    assert scored.where("p between 0 and 1 and ok = (p >= %s)" % card.threshold).count() == scored.count() > 0


def test_retry_loop(spark):
    ok, wrong = ("100.00", "5.00", "105.00"), ("100.00", "5.00", "999.00")
    rows = lambda d, v, tier=None, conf=0.95: (d, "INV", "2024-01-01", "Acme", *v, [], tier, conf)
    schema = "document_id string, invoice_number string, date string, vendor_name string, subtotal string, tax string, total_amount string, items array<struct<id:string,description:string,quantity:string,unit_price:string,total:string>>, fallback_tier string, ocr_confidence double"
    docs = spark.createDataFrame([rows("valid", ok), rows("mended", wrong), rows("never", wrong), rows("no_reply", wrong), rows("third", wrong), rows("odd", ok), rows("low", ok, None, 0.5), rows("person", wrong, "hitl")], schema)
    good = '{"invoice_number": "I", "date": "2024-01-01", "vendor_name": "A", "subtotal": "10", "tax": "1", "total_amount": "11", "line_items": [{"description": "x", "total": "10"}]}'
    bad = good.replace('"11"', '"99"')

    def replies(n):
        some = [("mended", good), ("never", "no json"), ("third", good if n == 3 else bad), ("odd", good), ("low", good)]
        return spark.createDataFrame([(d, r, 0.9) for d, r in some], "document_id string, reply string, confidence double")

    verify = lambda open_: open_.select("document_id", (~((F.col("document_id") == "odd") & (F.col("attempts") == 0))).alias("ok"))
    got = {r.document_id: (r.route, r.attempts, r.gate_reason, r.fallback_tier) for r in retry.reconcile(docs, replies, verify).collect()}
    assert got == {
        "valid": ("valid", 0, None, None), "mended": ("valid", 1, None, "vlm"), "never": ("hitl", 3, "math_mismatch", "vlm"), "no_reply": ("hitl", 1, "math_mismatch", "hitl"),
        "third": ("valid", 3, None, "vlm"), "odd": ("valid", 1, None, "vlm"), "low": ("valid", 1, None, "vlm"), "person": ("hitl", 0, "math_mismatch", "hitl"),
    }


def test_isolation_scores_are_above_the_cut(spark):
    df = spark.createDataFrame([(f"d{i}", 100.0 + i % 5, 0.9, 0) for i in range(60)] + [("odd", 1e6, 0.1, 9)], "document_id string, amount double, avg_confidence double, n_corrections long")
    got = forecast.isolation_forest(df).collect()
    assert "odd" in {r.document_id for r in got} and all(r.score >= 0 for r in got) and len(got) <= 7


def test_supplier_risk_updates_its_table(spark):
    metrics = spark.createDataFrame([(f"s{i}", i + 1, 0.1 * (i % 10), i) for i in range(12)], "supplier_name string, total_documents long, avg_confidence double, total_corrections long").withColumn("risk_score", F.lit(None).cast("double"))
    old = metrics.where("supplier_name = 's1'").withColumn("risk_score", F.lit(1.0)).unionByName(spark.createDataFrame([("gone", 1, 0.5, 0, 7.0)], metrics.schema))
    got = {r.supplier_name: r.risk_score for r in verifier.update_supplier_risk(old, metrics).collect()}
    assert len(got) == 13 and got["gone"] == 7.0 and all(0 <= v <= 100 for v in got.values())


def test_transitions_by_the_table(spark):
    allowed = [(a, b) for a, bs in review.TRANSITIONS.items() for b in bs]
    states = list(review.TRANSITIONS)
    steps = [(a, b) for a in states for b in states]
    import datetime as dt

    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, j), j, s) for k, pair in enumerate(steps) for j, s in enumerate(pair)]
    bad = {steps[r.key] for r in review.invalid_transitions(spark.createDataFrame(rows, "key int, ts timestamp, seq int, status string")).collect()}
    assert bad == set(steps) - set(allowed) and ("verified", "failed") in bad and ("received", "failed") not in bad
