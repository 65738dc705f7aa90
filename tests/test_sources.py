"""Files, streams, and jobs on empty or hand-made tables."""

import json

from pyspark.sql import functions as F

from quillspark.operators import documents, forecast, review, stats
from quillspark.plans import registry, verifier
from quillspark.sources import files
from quillspark.sources.ledger import SCHEMAS, Ledger, load_ledger, sales_ledger
from quillspark.streaming import jobs
from quillspark.streaming.run import ran

from .conftest import SF


def empty_ledger(spark):
    return Ledger(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def test_empty_ledger(spark):
    ap = empty_ledger(spark)
    trust = stats.trust_scores(ap)
    assert trust.count() == 0
    assert stats.vendor_risk(ap, trust).count() == 0
    assert stats.trust_overview(trust).first().message == "No documents"
    assert [r.documents for r in stats.trust_distribution(trust).collect()] == [0] * 5
    c = stats.compliance(ap).first()
    assert (c.correction_rate, c.avg_corrections) == (0.0, 0.0)
    assert stats.dashboard(ap).first().total_spend == 0.0
    for job in (stats.spend_by_vendor, stats.spend_by_month, stats.batch_status, documents.invoice_wide, review.review_queue, review.reconcile, review.audits, forecast.calibrate):
        assert job(ap).count() == 0
    assert forecast.anomalies(stats.document_stats(ap)).count() == 0


def test_load_ledger(spark, tmp_path):
    ap = sales_ledger(spark, SF)
    for name in SCHEMAS:
        df = getattr(ap, name)
        df.select(*[F.col(c) for c in df.columns]).limit(50).write.parquet(f"{tmp_path}/{name}.parquet")
    back = load_ledger(spark, str(tmp_path))
    assert back.fields.count() == 50
    assert back.documents.columns == [c.split()[0] for c in SCHEMAS["documents"].split(", ")]


def test_earliest_correction_wins(spark):
    rows = [("c1", "d", "f", "first", "x", "u", "2024-01-01 00:00:00"), ("c2", "d", "f", "second", "y", "u", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "id string, document_id string, field_id string, original_value string, corrected_value string, reviewed_by string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert documents.earliest_correction(df).first().original_value == "first"


def test_training_rows_have_no_limit(spark):
    ap = sales_ledger(spark, SF)
    corrected = ap.corrections.select("document_id").distinct().count()
    assert documents.correction_pairs(ap).count() == corrected > 500
    assert documents.correction_text_pairs(ap).count() == ap.corrections.select("field_id").distinct().count() > 500
    assert documents.clean_documents(ap).count() > documents.clean_documents(ap, 10).count() == 10


def test_upsert_null_period(spark):
    target = spark.createDataFrame([("m", None, 1.0), ("m", "a", 2.0)], "metric_name string, period string, metric_value double")
    updates = spark.createDataFrame([("m", None, 5.0, 1), ("m", None, 6.0, 2)], "metric_name string, period string, metric_value double, at int")
    got = {(r.period, r.metric_value) for r in documents.upsert(target, updates, ["metric_name", "period"], "at").collect()}
    assert got == {(None, 6.0), ("a", 2.0)}


def test_receipt_labels(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "lbl").mkdir()
    for name, body in {"a": '{"company": "Acme", "total": "1.00", "date": ""}', "b": "Company\tBeta: Ltd\nTotal: 2.00", "c": "company: x"}.items():
        (tmp_path / "lbl" / f"{name}.txt").write_text(body)
        if name != "c":
            (tmp_path / "img" / f"{name}.jpg").write_bytes(b"x")
    got = {r.sample: r.fields for r in files.read_receipt_labels(spark, f"{tmp_path}/img", f"{tmp_path}/lbl").collect()}
    assert got == {"a": {"vendor_name": "Acme", "total_amount": "1.00", "date": None}, "b": {"vendor_name": "Beta: Ltd", "total_amount": "2.00"}}


def test_nested_truth(spark):
    item = {"nm": "tea", "cnt": "1", "price": "2.00"}
    rows = [(json.dumps({"gt_parse": {"menu": m, "sub_total": {"subtotal_price": "2.00"}, "total": {"total_price": "2.10"}}}),) for m in (item, [item, item])]
    got = files.parse_nested_truth(spark.createDataFrame(rows, "ground_truth string")).collect()
    assert [(len(r["items"]), r["items"][0].description, r.subtotal, r.total_amount) for r in got] == [(1, "tea", "2.00", "2.10"), (2, "tea", "2.00", "2.10")]


def test_prediction_log_and_thresholds(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(json.dumps({"timestamp": t, "file": "a", "fields": {"x": t}, "raw_text": ""}) for t in ("1", "2")))
    assert files.read_prediction_log(spark, str(log)).first().fields == {"x": "2"}
    df = spark.createDataFrame([("date", 0.7)], "field_name string, threshold double")
    files.save_thresholds(df, f"{tmp_path}/t")
    assert files.load_thresholds(spark, f"{tmp_path}/t").first().threshold == 0.7
    files.save_thresholds(df, f"{tmp_path}/t", version=0)
    assert files.load_thresholds(spark, f"{tmp_path}/t").count() == 0
    fitted = spark.createDataFrame([("tax", 0.8, 12), ("date", None, 3)], "field_name string, threshold double, samples int")
    files.save_thresholds(fitted, f"{tmp_path}/t", default=0.6)
    assert {(r.field_name, r.threshold, r.fitted, r.samples, r.default_threshold) for r in files.load_calibration(spark, f"{tmp_path}/t").collect()} == {("tax", 0.8, True, 12, 0.6), ("date", 0.6, False, 3, 0.6)}
    assert {(r.field_name, r.threshold) for r in files.load_thresholds(spark, f"{tmp_path}/t").collect()} == {("tax", 0.8), ("date", None)}
    files.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().field_name == "date"


def test_corruptions_change_what_they_name(spark):
    wide = documents.invoice_wide(sales_ledger(spark, SF)).limit(200).cache()
    bad = verifier.corrupt(wide, 3)
    assert {r.operator for r in bad.select("operator").distinct().collect()} <= set(verifier.OPERATORS)
    both = bad.alias("b").join(wide.alias("w"), "document_id")
    same = both.where(" and ".join(f"b.{c} <=> w.{c}" for c in ("total_amount", "subtotal", "tax", "date", "vendor_name", "items")))
    assert same.count() <= 0.05 * bad.count()  # a digit may be dropped from among equals
    again = verifier.corrupt(wide.repartition(7), 3)
    assert bad.select("document_id", "copy", "operator", "total_amount").exceptAll(again.select("document_id", "copy", "operator", "total_amount")).count() == 0


def test_training_split(spark):
    wide = documents.invoice_wide(sales_ledger(spark, SF)).limit(300)
    rows = verifier.training_set(wide, k=1).groupBy("label").agg(F.count_if("validation").alias("v"), F.count("*").alias("n")).collect()
    assert all(abs(r.v - r.n / 5) <= 1 for r in rows) and len(rows) == 2


def test_verifier_learns_from_clean_and_corrected(spark):
    rows = registry._training_rows(spark, SF, k=1).select("document_id", "label", "weight", "operator").collect()
    ap = sales_ledger(spark, SF)
    clean = {r.document_id for r in documents.clean_documents(ap).collect()}
    corrected = {r.document_id for r in ap.corrections.select("document_id").distinct().collect()}
    assert {r.document_id for r in rows if r.operator == "clean"} == clean
    real = [r for r in rows if r.operator == "correction"]
    assert {r.document_id for r in real if r.label == 0} == {r.document_id for r in real if r.label == 1} == corrected
    assert {r.weight for r in real} == {4.0}


def test_identical_pairs_are_dropped(spark):
    wide = documents.invoice_wide(sales_ledger(spark, SF)).where("document_id < 'doc_102'")
    first = wide.agg(F.min("document_id")).first()[0]
    after = wide.withColumn("date", F.when(F.col("document_id") == first, "x").otherwise(F.col("date")))
    got = verifier.training_set(wide, wide, after, k=1).where("operator = 'correction'").select("document_id", "label").collect()
    assert sorted((r.document_id, r.label) for r in got) == [(first, 0), (first, 1)]


def test_verifier_queries_return_their_columns(spark):
    assert set(verifier.FEATURES) <= set(registry.QUERIES["m10_features_all"](spark, SF).columns)
    for name in ("m11_corrupt", "m12_training_set"):
        assert {*verifier.FIELDS, "items", "operator"} <= set(registry.QUERIES[name](spark, SF).columns)


def test_score_without_model(spark):
    wide = documents.invoice_wide(sales_ledger(spark, SF)).limit(3)
    got = verifier.score(verifier.features(wide, "1998-01-01"), None).collect()
    assert all(r.ok and r.reason == "skipped" for r in got)


def test_late_events_are_ignored(spark, tmp_path):
    for k, rows in enumerate(([(1, 1, 5, "received"), (1, 3, 3, "preprocessed")], [(1, 2, 9, "verified"), (1, 4, 1, "verified")])):
        spark.createDataFrame(rows, "key long, ts long, seq long, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key long, ts long, seq long, status string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = [(r.seq, r.before, r.status) for r in ran(jobs.invalid_transitions(stream), "append").collect()]
    assert got == [(1, "preprocessed", "verified")]


def test_verifier_is_saved_with_its_metrics(spark, tmp_path):
    rows = [(f"d{k}", k % 2, 1.0, k % 5 == 0, "clean" if k % 2 else "digit_drop", *[float((k % 2) * 3 + (k * 7 + j) % 3) for j in range(len(verifier.FEATURES))]) for k in range(200)]
    schema = "document_id string, label int, weight double, validation boolean, operator string, " + ", ".join(f"{f} double" for f in verifier.FEATURES)
    table = spark.createDataFrame(rows, schema)
    model = verifier.train_verifier(table, rounds=5, leaves=4)
    assert model.metrics["auroc"] > 0.95 and set(model.recalls) == {"digit_drop"} and model.metrics["positives"] == 100
    verifier.save_verifier(model, spark, f"{tmp_path}/v")
    again = verifier.load_verifier(spark, f"{tmp_path}/v")
    assert (again.threshold, again.means, again.metrics, again.recalls) == (model.threshold, model.means, model.metrics, model.recalls)
    scored = [[(r.document_id, r.p, r.ok) for r in verifier.score(table, m).orderBy("document_id").collect()] for m in (model, again)]
    assert scored[0] == scored[1] and {ok for _, _, ok in scored[0]} == {True, False}
