"""Literal cases of single rules."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import amounts, audit, extract, text
from quillspark.operators import forecast, layout, quality, review
from quillspark.plans.registry import QUERIES
from quillspark.sources.ledger import text_pairs, view

from .conftest import SF


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


@pytest.mark.parametrize(
    ("given", "value"),
    [("1,500.", 1500), ("1500.", None), ("1,50,000", None), ("12345,678", 12345678), ("$-5", -5), ("-$5", None), ("1.5,000", None), ("USD 1,234.50", 1234.5), ("7 eur", 7), ("", None), (None, None), ("€ 1 000", 1000)],
)
def test_currency(spark, given, value):
    got = one(spark, [(given,)], "a string", v=amounts.parse_amount(F.col("a")).cast("double"))[0].v
    assert got == value


def test_floats(spark):
    given = ["1_000", "1d", "1.5f", "nan", "inf", " 2.5 ", "1e3", "x", None]
    got = [r.v for r in one(spark, [(g,) for g in given], "a string", v=amounts.amt_float(F.col("a")))]
    assert got == [1000.0, None, None, None, None, 2.5, 1000.0, None, None]


def test_dates(spark):
    given = ["2025-1-5", "15/03/2024", "03/15/2024", "5 Jan 2024", "January 5, 2024", "2024-13-01", "20-1-5"]
    got = [str(r.v) for r in one(spark, [(g,) for g in given], "a string", v=amounts.parse_date_any(F.col("a")))]
    assert got == ["2025-01-05", "2024-03-15", "2024-03-15", "2024-01-05", "2024-01-05", "None", "None"]


@pytest.mark.parametrize(
    ("sub", "tax", "total", "reason", "field"),
    [("200", "30", "230", None, None), ("200", "30", "2300", "math_mismatch", "total"), ("1500", "0", "150", "math_mismatch", "subtotal"), ("20", "3", "2300", "math_mismatch", "total"), ("200", "30", "235", "math_mismatch", None), (None, "3", "23", "partial_data", None), ("20", "3", "x", "unreadable_total", None), ("20", "3", None, "missing_total", None)],
)
def test_audit(spark, sub, tax, total, reason, field):
    df = spark.createDataFrame([(sub, tax, total)], "subtotal string, tax string, total_amount string")
    r = audit.magnitude_slip(audit.audit(df)).first()
    assert r.audit_reason == reason
    assert r.slip_field == field


def test_edit_ops(spark):
    pairs = [("ab", "ba"), ("", "abc"), ("abc", ""), ("kitten", "sitting"), (None, None), ("été", "ete")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(text.edit_ops(text.chars(F.col("a")), text.chars(F.col("b"))).alias("o")).collect()
    assert [tuple(r.o) for r in got] == [(2, 0, 0, 0), (0, 0, 3, 0), (0, 3, 0, 0), (2, 0, 1, 4), (0, 0, 0, 0), (2, 0, 0, 1)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_whole_texts_are_compared(spark):
    texts = {r.doc_id: r.text for r in view(spark, SF, "documents").collect()}
    assert any(not t.isascii() for t in texts.values()) and max(map(len, texts.values())) > 1000
    rows = text_pairs(spark, SF).select("*", F.levenshtein("reference", "hypothesis").alias("e"), text.word_edits(F.col("reference"), F.col("hypothesis")).alias("w")).collect()
    parts = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        parts[r.doc_id] = parts.get(r.doc_id, "") + r.reference
    assert parts == texts
    assert {r.field_name for r in rows} == {"vendor_name", "date", "total_amount", "invoice_number"}
    assert any(r.hypothesis is None for r in rows)
    some = [r for r in rows if r.hypothesis is not None and (r.doc_id + r.pos) % 37 == 0]
    assert all((r.e, r.w) == (edits(r.reference, r.hypothesis), edits(r.reference.split(), r.hypothesis.split())) for r in some)
    assert QUERIES["f12_edit_ops"](spark, SF).agg(F.sum(F.col("c") + F.col("s") + F.col("d"))).first()[0] == sum(map(len, texts.values()))
    assert sum(r.n for r in QUERIES["q1_corpus_cer"](spark, SF).collect()) == len(rows)


def test_text_edit_ops(spark):
    pairs = [("ab", "ba"), ("", "abc"), ("abc", ""), ("kitten", "sitting"), (None, None), ("\u00e9t\u00e9", "ete"), ("abcabba", "cbabac"), ("x" * 30 + "abc", "abcx" * 8), ("same", "same"), ("\U0001d11ea", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = df.select(text.text_edit_ops(F.col("a"), F.col("b")).alias("o"), text.edit_ops(text.chars(F.col("a")), text.chars(F.col("b"))).alias("q")).collect()
    assert [r.o for r in got[:-1]] == [r.q for r in got[:-1]]
    assert tuple(got[-1].o) == (0, 1, 0, 1)


def test_rates(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("", "p q"), (None, None)], "a string, b string")
    got = df.select(text.cer(F.col("a"), F.col("b")).alias("c"), text.wer(F.col("a"), F.col("b")).alias("w")).collect()
    assert [(r.c, r.w) for r in got] == [(0.2, 1 / 3), (1.0, 1.0), (0.0, 0.0)]


def test_match_class(spark):
    rows = [(None, None, "date"), ("x", None, "date"), (None, "x", "date"), ("$1,0", "10", "tax"), ("10.01", "10.00", "tax"), ("acme co", "acme cp", "vendor_name"), ("aaaa", "bbbb", "vendor_name")]
    got = [r.c for r in one(spark, rows, "p string, t string, f string", c=text.match_class(F.col("p"), F.col("t"), F.col("f")))]
    assert got == ["both_null", "hallucination", "miss", "exact", "numeric_ok", "fuzzy", "wrong"]


def test_replies(spark):
    rows = [("",), ("no",), ('{"date": ',), ('```json\n{"date": "2024-01-01", "tax": null}\n```',), ("{bad}",)]
    got = [(r.r.reason, r.r.date) for r in one(spark, rows, "a string", r=text.parse_reply(F.col("a")))]
    assert got == [("empty_output", None), ("no_json_found", None), ("no_json_found", None), (None, "2024-01-01"), ("json_decode_error", None)]


def test_extract(spark):
    doc = "From: Acme, \nInvoice No: INV-1\nDate 2024-02-03\nSub-total $10.00\nVAT 1.00\nGrand Total: $11.00"
    got = one(spark, [(doc,)], "a string", **extract.extract_fields(F.col("a")))[0]
    assert (got.invoice_number, got.date, got.subtotal, got.tax, got.total_amount) == ("INV-1", "2024-02-03", "10.00", "1.00", "11.00")


def blocks(spark, rows):
    return spark.createDataFrame([("d", 1, i, t, 0.9, *map(float, b)) for i, (t, *b) in enumerate(rows)], "document_id string, page int, pos int, text string, score double, x1 double, y1 double, x2 double, y2 double")


def test_layout(spark):
    b = blocks(spark, [("Total", 0, 40, 50, 50), ("$11.00", 100, 41, 150, 51), ("Tax", 0, 20, 50, 30), ("1.00", 0, 32, 50, 38), ("Vendor", 0, 0, 50, 10), ("Acme", 60, 2, 90, 12)])
    got = {r.field_name: r.value for r in layout.pair_labels(b).collect()}
    assert got == {"total_amount": "11.00", "tax": "1.00", "vendor_name": "Acme"}
    assert layout.reading_order(b).first().text.split("\n")[0] == "Vendor Acme"
    assert layout.pair_labels(b.limit(0)).count() == 0


def test_metrics_against_pairs(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]
    got = quality.ranking_metrics(spark.createDataFrame(rows, "p double, label int")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got.auroc - want) < 1e-8
    empty = quality.best_threshold(spark.createDataFrame([], "p double, label int")).first()
    assert (empty.threshold, empty.f1) == (0.5, 0.0)


def test_forecasts(spark):
    line = [(f"2024-{m:02d}", 10.0 * m) for m in range(1, 13)]
    df = spark.createDataFrame(line, "month string, value double")
    assert [(r.month, r.forecast) for r in forecast.forecast_linear(df, 2).orderBy("month").collect()] == [("2025-01", 130.0), ("2025-02", 140.0)]
    one_month = spark.createDataFrame(line[:1], "month string, value double")
    assert [r.forecast for r in forecast.forecast_linear(one_month, 2).collect()] == [10.0, 10.0]
    assert {r.method for r in forecast.forecast_ar(one_month, 1).collect()} == {"linear"}
    assert {r.method for r in forecast.forecast_ar(df.withColumn("value", F.col("value") + F.rand(1)), 1).collect()} == {"ar"}


def test_isolation_forest_finds_the_outlier(spark):
    rows = [(f"d{i}", 100.0 + i % 5, 0.9, 0) for i in range(60)] + [("odd", 90000.0, 0.1, 9)]
    df = spark.createDataFrame(rows, "document_id string, amount double, avg_confidence double, n_corrections int")
    assert "odd" in {r.document_id for r in forecast.isolation_forest(df).collect()}


def test_transitions(spark):
    log = spark.createDataFrame([(1, 1, 1, "uploaded"), (1, 2, 2, "approved"), (2, 1, 3, "rejected"), (2, 2, 4, "approved")], "key int, ts int, seq int, status string")
    assert {(r.key, r.before) for r in review.invalid_transitions(log).collect()} == {(1, "uploaded"), (2, "rejected")}


def test_receipt(spark):
    doc = "\n12\nReceipt\nBig Shop Ltd\nDate: 03/02/2024\nSub Total: 9.00\nGST: 1.00\nTotal 10.00\nTotal Amount: 1,010.00\nCash: 20.00\nChange: 10.00\nINV# 77"
    got = one(spark, [(doc,), ("",), (None,)], "a string", **extract.extract_receipt(F.col("a")))
    assert (got[0].merchant_name, got[0].date, got[0].total_amount, got[0].tax_amount, got[0].subtotal, got[0].cash_tendered, got[0].change, got[0].invoice_number) == ("Big Shop Ltd", "03/02/2024", "1010.00", "1.00", "9.00", "20.00", "10.00", "77")
    assert {got[1].merchant_name, got[2].merchant_name} == {None}


def test_keyed_fields(spark):
    """Literal cases of the keyword rules."""
    texts = ["Invoice #INV-2025-00123", "INV-2025-001 for services", "Invoice: 20250012", "No invoice info here", "Date: 2025-01-15", "Invoice Date: 01/15/2025", "Date: January 15, 2025", "seen 2025-01-15, issued 1/2/2024",
             "Subtotal: $1,200.00\nTax: $96.00\nTotal Amount Due: $1,296.00", "items: $50.00, $100.00, $200.00", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", *[c.alias(n) for n, c in extract.extract_keyed(F.col("t")).items()])
    got = {r.k: r for r in df.collect()}
    assert [got[k].invoice_number for k in range(4)] == ["Invoice #INV-2025-00123", "INV-2025-001", "Invoice: 20250012", None]
    assert [(got[k].date, got[k].date_confidence) for k in range(3, 8)] == [(None, None), ("2025-01-15", 0.93), ("2025-01-15", 0.93), ("2025-01-15", 0.93), ("2024-01-02", 0.93)]
    assert (got[8].subtotal, got[8].tax, got[8].total_amount, got[8].total_amount_confidence) == ("1200.00", "96.00", "1296.00", 0.88)
    assert (got[9].total_amount, got[9].subtotal, got[9].tax_confidence) == ("200.00", None, None)
    assert all(v is None for k in (10, 11) for v in list(got[k])[1:])


def test_items_of_tables(spark):
    tables = [
        [[["Description", "Qty", "Unit Price", "Total"], ["Widget A", "10", "100.00", "1000.00"], ["Widget B", "5", "$2,000.50", "x"], [None, "1"], [" "], ["C"], None]],
        [], [[["Header only"]]], [[["Column A", "Column B"], ["a", "b"]]], None, [None, [None, ["a"]], [["Discount", None, "ITEM total"], ["3", "9", "thing"]]],
    ]
    df = spark.createDataFrame(list(enumerate(tables)), "k int, t array<array<array<string>>>").select("k", extract.items_from_tables(F.col("t")).alias("items"))
    got = {r.k: [tuple(x) for x in r["items"]] for r in df.collect()}
    assert got[0] == [("Widget A", 10.0, 100.0, 1000.0), ("Widget B", 5.0, 2000.5, 0.0), ("C", 0.0, 0.0, 0.0)]
    assert got[1] == got[2] == got[3] == got[4] == [] and got[5] == [("thing", 3.0, 0.0, 0.0)]


def test_slip_sentences(spark):
    rows = [("$1,000.00", "50.00", "105.00", "105.00"), ("100.00", "0010.0", "1,100.00", None), ("3.00", "4.00", "900.00", "90.00"), ("1.00", "1.00", "2.00", "2.00"), (None, "1", "5", "5")]
    df = spark.createDataFrame(rows, "subtotal string, tax string, total_amount string, items string").withColumn("items", F.col("items").cast("decimal(18,2)"))
    got = {r.total_amount: (r.slip_direction, r.slip_text) for r in audit.slip_sentence(audit.magnitude_slip(audit.audit(df), "items"), "items").collect()}
    way, said = got["105.00"]
    assert way == "too_small" and said == "magnitude_error: likely decimal-point slip in total \u2014 reported total appears too small by a factor of ~0.1 relative to the other two fields. Observed: subtotal=1000.00, tax=50.00, total=105.00. Re-scan the total field digit by digit and verify decimal placement before returning a value."
    assert got["1,100.00"][0] is not None and "tax=10.0, total=1100.00" in got["1,100.00"][1]
    assert got["900.00"] == (None, "magnitude_error: the reported total (900.00) is ~10x the sum of line items (90.00). The subtotal+tax triangulation was inconclusive, so a line item may also be mis-extracted. Re-scan every line item's amount and the total field, verifying decimal placement.")
    assert got["2.00"] == got["5"] == (None, None)
