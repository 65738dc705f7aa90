"""Queries over the sales ledger, each with the equivalent SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, audit, extract, text
from ..operators import documents as D
from ..operators import forecast as M
from ..operators import layout as L
from ..operators import quality as Q
from ..operators import review as R
from ..operators import stats as A
from ..operators.retry import reconcile
from ..sources import files as S
from ..sources.ledger import VIEWS, sales_ledger, text_pairs, view, view_sql
from ..sources.shared import shared_folder, stored
from ..sources.tables import KeyedTable
from ..streaming import jobs as J
from ..streaming.run import ran
from . import verifier as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = view_sql(*views) + sql


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


#: A float's text, in the other engine's SQL.
_FLOAT = r"^\s*[+-]?(\d+(_?\d)*)?(\.(\d+(_?\d)*)?)?([eE][+-]?\d+)?\s*$"


def _num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{_FLOAT}') AND regexp_matches({c}, '\\d') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def _first(name: str, out: str) -> str:
    return f"min_by(field_value, id) FILTER (field_name = '{name}') AS {out}"


#: Field values, items and corrections per document, then trust, in the other engine's SQL.
_VALUES = f"SELECT document_id, {_first('vendor_name', 'vendor_name')}, {_first('total_amount', 'total_amount')}, {_first('invoice_number', 'invoice_number')}, {_first('date', 'date')}, {_first('subtotal', 'subtotal')}, {_first('tax', 'tax')} FROM ap_fields GROUP BY document_id"
_ITEMS = "SELECT document_id, count(*) AS n_items, sum(CAST(total AS DECIMAL(18,2))) AS items_total FROM ap_line_items GROUP BY document_id"
_CORR = "SELECT document_id, count(*) AS n_corrections FROM ap_corrections GROUP BY document_id"
_ALL = ("ap_documents", "ap_fields", "ap_line_items", "ap_corrections")
_MISSING = " + ".join(f"CASE WHEN trim(coalesce({f}, '')) = '' THEN 1 ELSE 0 END" for f in ("invoice_number", "date", "vendor_name", "total_amount"))
_TRUST = f"""
  t1 AS (SELECT d.id AS document_id, f.c, coalesce(f.n_invalid, 0) AS n_invalid, {_MISSING} AS n_missing, coalesce(n_corrections, 0) AS n_corrections,
      n_items, coalesce(list_filter(names, lambda x: x IS NOT NULL)[:4], []) AS invalid_names, list_sort(list_filter([CASE WHEN trim(coalesce(invoice_number, '')) = '' THEN 'invoice_number' END, CASE WHEN trim(coalesce(date, '')) = '' THEN 'date' END, CASE WHEN trim(coalesce(vendor_name, '')) = '' THEN 'vendor_name' END, CASE WHEN trim(coalesce(total_amount, '')) = '' THEN 'total_amount' END], lambda x: x IS NOT NULL)) AS missing_names,
      coalesce(n_items IS NOT NULL AND abs(CAST(items_total AS DOUBLE) - ({_num('total_amount')})) >= 0.01, false) AS mismatch
    FROM ap_documents d LEFT JOIN (SELECT document_id, avg(confidence) AS c, count(*) FILTER (status = 'invalid') AS n_invalid, list(field_name ORDER BY created_at, id) FILTER (status = 'invalid') AS names FROM ap_fields GROUP BY document_id) f ON f.document_id = d.id
      LEFT JOIN ({_VALUES}) v ON v.document_id = d.id LEFT JOIN ({_ITEMS}) i ON i.document_id = d.id LEFT JOIN ({_CORR}) c ON c.document_id = d.id),
  t2 AS (SELECT *, CASE WHEN c IS NULL THEN 15.0 ELSE greatest(0.0, least(30.0, (1 - c) * 30)) END + CASE WHEN c < 0.5 THEN 8 ELSE 0 END + least(20, 7 * n_invalid) + least(25, 8 * n_missing) + least(15, 5 * n_corrections) + CASE WHEN mismatch THEN 12 ELSE 0 END AS penalty FROM t1),
  t3 AS (SELECT *, CAST(greatest(0, least(100, round_even(100 - penalty, 0))) AS INTEGER) AS trust_score FROM t2),
  trust AS (SELECT *, CASE WHEN n_missing >= 2 OR trust_score < 25 THEN 'Reject / Incomplete' WHEN trust_score < 50 OR mismatch OR n_invalid >= 2 OR n_corrections >= 3 THEN 'Escalate'
      WHEN trust_score < 80 OR n_invalid > 0 OR n_corrections > 0 OR n_missing > 0 THEN 'Needs Human Review' ELSE 'Auto-Approve Candidate' END AS priority FROM t3)"""


def _with_trust(sql: str) -> str:
    return view_sql(*_ALL).rstrip() + f", {_TRUST} " + sql


def _ap(f: Callable) -> Query:
    return lambda spark, sf: f(sales_ledger(spark, sf))


def _trust(f: Callable) -> Query:
    return lambda spark, sf: f(A.trust_scores(sales_ledger(spark, sf)))


# Aggregates over the ledger
add("a1_processing_stats", _ap(A.processing_stats), "SELECT status, count(*) AS documents FROM ap_documents GROUP BY status", "ap_documents")
_SPEND = f"SELECT vendor_name, CAST(sum(CAST(coalesce({_num('total_amount')}, 0) AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, count(*) AS documents FROM ({_VALUES}) WHERE coalesce(vendor_name, '') <> '' GROUP BY vendor_name"
add("a2_spend_by_vendor", _ap(A.spend_by_vendor), _SPEND, "ap_fields")
_MONTH = f"SELECT strftime(uploaded_at, '%Y-%m') AS month, CAST(coalesce(sum(CAST(coalesce({_num('total_amount')}, 0) AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_spend, count(*) AS documents FROM ap_documents LEFT JOIN ({_VALUES}) v ON v.document_id = id WHERE status IN ('approved', 'review_pending', 'rejected') GROUP BY 1"
add("a3_spend_by_month", _ap(A.spend_by_month), _MONTH, "ap_documents", "ap_fields")
add("a8_monthly_trend", _ap(A.monthly_trend), f"SELECT * FROM ({_MONTH}) ORDER BY month DESC LIMIT 12", "ap_documents", "ap_fields")
_STATS = f"SELECT id AS document_id, avg_confidence, CASE WHEN v.document_id IS NOT NULL THEN coalesce({_num('total_amount')}, 0) END AS amount, coalesce(n_corrections, 0) AS n_corrections FROM ap_documents LEFT JOIN (SELECT document_id, avg(confidence) AS avg_confidence FROM ap_fields GROUP BY document_id) f ON f.document_id = id LEFT JOIN ({_VALUES}) v ON v.document_id = id LEFT JOIN ({_CORR}) c ON c.document_id = id"
add("a4_document_stats", lambda s, d: A.document_stats(sales_ledger(s, d)).withColumn("avg_confidence", F.round("avg_confidence", 8)), f"SELECT document_id, round(avg_confidence, 8) AS avg_confidence, amount, n_corrections FROM ({_STATS})", *_ALL)
add("a5_dashboard", lambda s, d: A.dashboard(sales_ledger(s, d)).withColumns({c: _labels(c) for c in ("documents_by_status", "validation_failures")}), None)
add("a6_validation_breakdown", _ap(A.validation_breakdown), "SELECT field_name, count(*) AS invalid FROM ap_fields WHERE status = 'invalid' GROUP BY field_name", "ap_fields")
add("a7_compliance", _ap(A.compliance), f"SELECT round(count(*) FILTER (n_corrections > 0) / count(*) * 100, 2) AS correction_rate, round(sum(n_corrections) / count(*), 2) AS avg_corrections, count(*) FILTER (n_corrections > 0) AS with_corrections, count(*) FILTER (n_corrections = 0) AS without_corrections FROM ({_STATS})", *_ALL)
_METRICS = f"SELECT vendor_name AS supplier_name, count(*) AS total_documents, CAST(round(CAST(coalesce(avg(avg_confidence), 0) AS DECIMAL(18,10)), 4) AS DOUBLE) AS avg_confidence, CAST(sum(n_corrections) AS BIGINT) AS total_corrections, CAST(NULL AS DOUBLE) AS risk_score FROM ({_STATS}) s JOIN (SELECT document_id, vendor_name FROM ({_VALUES})) v USING (document_id) WHERE coalesce(vendor_name, '') <> '' GROUP BY vendor_name"
add("a9_supplier_metrics", _ap(A.supplier_metrics), _METRICS, *_ALL)
_RISK = f"SELECT supplier_name, total_documents, avg_confidence, total_corrections, round(greatest(0, least(100, (1 - avg_confidence) * 60 + (1 - least(total_documents / 10, 1.0)) * 40)), 2) AS risk_score FROM ({_METRICS})"
add("m3_supplier_risk", _ap(lambda ap: A.supplier_risk(A.supplier_metrics(ap))), _RISK, *_ALL)
add("a10_supplier_list", _ap(lambda ap: A.supplier_list(A.supplier_risk(A.supplier_metrics(ap)))), f"SELECT *, CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS risk_level FROM ({_RISK})", *_ALL)
QUERIES["a11_trust_scores"] = _trust(lambda t: t.drop("c").withColumn("reasons", F.array_join("reasons", "; ")))
_PENALTY = "CASE WHEN c IS NULL THEN 15.0 ELSE greatest(0.0, least(30.0, (1 - c) * 30)) END"
_PERCENT = "printf('%.1f', round_even(round(c * 100, 6), 1))"
SQL["a11_trust_scores"] = _with_trust(f"""SELECT document_id, trust_score, priority, n_invalid, n_missing, n_corrections, mismatch, round_even(round({_PENALTY}, 6), 1) AS p_confidence, CASE WHEN c < 0.5 THEN 8.0 ELSE 0.0 END AS p_very_low, CAST(least(20, 7 * n_invalid) AS DOUBLE) AS p_invalid, CAST(least(25, 8 * n_missing) AS DOUBLE) AS p_missing, CAST(least(15, 5 * n_corrections) AS DOUBLE) AS p_corrections, CASE WHEN mismatch THEN 12.0 ELSE 0.0 END AS p_mismatch,
  coalesce(nullif(concat_ws('; ', CASE WHEN c IS NULL THEN 'Confidence data unavailable (no fields extracted)' WHEN round({_PENALTY}, 6) > 20 THEN 'Low extraction confidence (' || {_PERCENT} || '%) — high OCR uncertainty' WHEN round({_PENALTY}, 6) > 8 THEN 'Moderate extraction confidence (' || {_PERCENT} || '%)' END,
    CASE WHEN c < 0.5 THEN 'Confidence critically below 50% — result reliability is low' END, CASE WHEN n_invalid > 0 THEN n_invalid || ' invalid field(s): ' || array_to_string(invalid_names, ', ') END, CASE WHEN n_missing > 0 THEN 'Missing required field(s): ' || array_to_string(missing_names, ', ') END,
    CASE WHEN n_corrections > 0 THEN n_corrections || ' human correction(s) required during review' END, CASE WHEN mismatch THEN 'Line-item sum does not match declared invoice total' END), ''), 'All quality checks passed') AS reasons FROM trust""")


def _labels(c: str):
    """An array of labels and counts as text."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["label"], x["n"].cast("string"))), ",").alias(c)


QUERIES["a12_trust_overview"] = _trust(lambda t: A.trust_overview(t).withColumns({c: _labels(c) for c in ("distribution", "priorities")}))
_COUNTED = lambda cases: " || ',' || ".join(f"'{label}=' || count(*) FILTER ({cond})" for label, cond in cases)
SQL["a12_trust_overview"] = _with_trust("SELECT count(*) AS documents, round(avg(trust_score), 1) AS avg_trust, " + _COUNTED([(f"{a}-{b}", f"trust_score BETWEEN {a} AND {b}") for a, b in ((0, 20), (21, 40), (41, 60), (61, 80), (81, 100))]) + " AS distribution, " + _COUNTED([(x, f"priority = '{x}'") for x in ("Auto-Approve Candidate", "Needs Human Review", "Escalate", "Reject / Incomplete")]) + " AS priorities, CAST(NULL AS VARCHAR) AS message FROM trust")
QUERIES["a13_trust_distribution"] = _trust(A.trust_distribution)
SQL["a13_trust_distribution"] = _with_trust("SELECT bucket, pos, count(document_id) AS documents FROM (VALUES ('0-20', 0, 0, 20), ('21-40', 1, 21, 40), ('41-60', 2, 41, 60), ('61-80', 3, 61, 80), ('81-100', 4, 81, 100)) b(bucket, pos, lo, hi) LEFT JOIN trust ON trust_score BETWEEN lo AND hi GROUP BY bucket, pos")
QUERIES["a14_priority_distribution"] = _trust(A.priority_distribution)
SQL["a14_priority_distribution"] = _with_trust("SELECT b.priority, pos, count(document_id) AS documents FROM (VALUES ('Auto-Approve Candidate', 0), ('Needs Human Review', 1), ('Escalate', 2), ('Reject / Incomplete', 3)) b(priority, pos) LEFT JOIN trust ON trust.priority = b.priority GROUP BY b.priority, pos")
QUERIES["a15_flagged"] = _trust(A.flagged)
SQL["a15_flagged"] = _with_trust("SELECT document_id, trust_score, priority, CASE priority WHEN 'Reject / Incomplete' THEN 0 WHEN 'Escalate' THEN 1 ELSE 2 END AS pos FROM trust WHERE priority <> 'Auto-Approve Candidate'")


def _vendor_risk(spark: SparkSession, sf: str) -> DataFrame:
    ap = sales_ledger(spark, sf)
    facts = A.stored_facts(ap)
    return A.vendor_risk(ap, A.trust_scores(ap, facts), facts=facts).withColumn("reasons", F.array_join("reasons", "; "))


_VENDOR_RISK = f"""SELECT vendor, documents, CAST(greatest(0, least(100, round_even(round(p_corrections + p_invalid + p_low_trust + p_variation + p_missing, 6), 0))) AS INTEGER) AS risk_score, avg_trust, total_corrections, p_corrections, p_invalid, p_low_trust, p_variation, p_missing,
    coalesce(nullif(concat_ws('; ', CASE WHEN ac >= 2 THEN 'High correction rate: avg ' || printf('%.1f', round_even(round(ac, 8), 1)) || ' corrections per document' WHEN ac >= 1 THEN 'Repeated human corrections: avg ' || printf('%.1f', round_even(round(ac, 8), 1)) || ' per document' END,
      CASE WHEN wi / documents >= 0.5 THEN wi || '/' || documents || ' documents had invalid fields (' || printf('%.0f', round_even(round(wi / documents * 100, 8), 0)) || '%)' WHEN wi > 0 THEN 'Some documents contained invalid fields (' || printf('%.0f', round_even(round(wi / documents * 100, 8), 0)) || '%)' END,
      CASE WHEN lt > 0 THEN lt || '/' || documents || ' documents scored below 50 on trust' END,
      CASE WHEN cv > 0.5 THEN 'High invoice amount variability (CV=' || printf('%.2f', round_even(round(cv, 8), 2)) || ') — possible duplicate or outlier invoices' WHEN cv > 0.3 THEN 'Moderate invoice amount variability (CV=' || printf('%.2f', round_even(round(cv, 8), 2)) || ')' END,
      CASE WHEN wm > 0 THEN wm || '/' || documents || ' documents had missing required fields' END), ''), 'No significant risk signals detected') AS reasons
  FROM (SELECT vendor, count(*) AS documents, CAST(sum(n_corrections) AS BIGINT) AS total_corrections, avg(n_corrections) AS ac, count(*) FILTER (n_invalid > 0) AS wi, count(*) FILTER (trust_score < 50) AS lt, count(*) FILTER (n_missing > 0) AS wm, CASE WHEN count(amount) FILTER (amount > 0) >= 2 THEN stddev_pop(amount) FILTER (amount > 0) / avg(amount) FILTER (amount > 0) ELSE 0 END AS cv, round(avg(trust_score), 1) AS avg_trust, round(least(25, 12 * avg(n_corrections)), 2) AS p_corrections, round(25 * avg(CAST(n_invalid > 0 AS INTEGER)), 2) AS p_invalid, round(20 * avg(CAST(trust_score < 50 AS INTEGER)), 2) AS p_low_trust,
      round(least(20, 20 * CASE WHEN count(amount) FILTER (amount > 0) >= 2 THEN stddev_pop(amount) FILTER (amount > 0) / avg(amount) FILTER (amount > 0) ELSE 0 END), 2) AS p_variation, round(10 * avg(CAST(n_missing > 0 AS INTEGER)), 2) AS p_missing
    FROM (SELECT document_id, trim(vendor_name) AS vendor, {_num('total_amount')} AS amount FROM ({_VALUES})) v JOIN trust USING (document_id) WHERE vendor <> '' GROUP BY vendor)"""
QUERIES["a16_vendor_risk"] = _vendor_risk
SQL["a16_vendor_risk"] = _with_trust(f"SELECT *, CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS risk_level, CASE WHEN risk_score >= 70 THEN 'Escalate for compliance review — multiple risk factors present' WHEN risk_score >= 50 THEN 'Flag for senior reviewer — moderate risk detected' WHEN risk_score >= 30 THEN 'Standard review recommended' ELSE 'Low risk — standard processing' END AS action FROM ({_VENDOR_RISK})")
QUERIES["s5_bi_vendor_risk"], SQL["s5_bi_vendor_risk"] = QUERIES["a16_vendor_risk"], SQL["a16_vendor_risk"]
add("a17_sla", _ap(A.sla), "SELECT round(avg(epoch(processed_at) - epoch(uploaded_at)), 2) AS avg_processing_s, round(avg(epoch(approved_at) - epoch(uploaded_at)), 2) AS avg_approval_s, count(*) FILTER (epoch(approved_at) - epoch(uploaded_at) > 86400) AS breaches FROM ap_documents", "ap_documents")
#: now() is a parameter; the sales tables end in these days.
NOW = "1998-08-01 00:00:00"
_RECENT = f"uploaded_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND uploaded_at <= TIMESTAMP '{NOW}'"
add("a18_throughput", _ap(lambda ap: A.throughput(ap, NOW)), f"SELECT strftime(uploaded_at, '%Y-%m-%d') AS day, count(*) AS documents FROM ap_documents WHERE {_RECENT} GROUP BY 1", "ap_documents")
add("a19_correction_patterns", _ap(A.correction_patterns), "SELECT field_name, count(*) AS corrections FROM ap_corrections c JOIN ap_fields f ON f.id = c.field_id GROUP BY field_name ORDER BY 2 DESC, 1 LIMIT 10", "ap_corrections", "ap_fields")
add("a20_confidence_drift", _ap(lambda ap: A.confidence_drift(ap, NOW)), f"SELECT strftime(uploaded_at, '%Y-%m-%d') AS day, round(avg(coalesce(confidence_score, m)), 3) AS avg_confidence, count(*) AS documents FROM ap_documents LEFT JOIN (SELECT document_id, avg(confidence) AS m FROM ap_fields GROUP BY document_id) f ON f.document_id = id WHERE {_RECENT} AND coalesce(confidence_score, m) IS NOT NULL GROUP BY 1", "ap_documents", "ap_fields")
_BATCH = "SELECT batch_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in A.BATCH_STATES) + f", CAST(coalesce(sum(n_fields), 0) AS BIGINT) AS fields, CAST(coalesce(sum(n_items), 0) AS BIGINT) AS items, count(*) AS documents FROM ap_documents LEFT JOIN (SELECT document_id, count(*) AS n_fields FROM ap_fields WHERE coalesce(field_value, '') <> '' GROUP BY document_id) f ON f.document_id = id LEFT JOIN ({_ITEMS}) i ON i.document_id = id WHERE batch_id IS NOT NULL GROUP BY batch_id"
add("a21_batch_status", _ap(A.batch_status), _BATCH, *_ALL)
add("a21_finalize_batches", _ap(A.finalize_batches), f"SELECT batch_id, CASE WHEN uploaded + processing > 0 THEN 'processing' WHEN failed > 0 THEN 'partial_failed' ELSE 'completed' END AS status FROM ({_BATCH})", *_ALL)
_SUMMARY = "SELECT d.id AS document_id, count(*) FILTER (f.status = 'valid') AS n_valid, count(*) FILTER (f.status = 'invalid') AS n_invalid, count(*) FILTER (f.status = 'corrected') AS n_corrected, count(*) FILTER (f.status = 'pending') AS n_pending, count(*) FILTER (f.status IN ('invalid', 'pending')) = 0 AS all_resolved FROM ap_documents d LEFT JOIN ap_fields f ON f.document_id = d.id GROUP BY d.id"
add("a22_validation_summary", _ap(D.validation_summary), _SUMMARY, "ap_documents", "ap_fields")
_CRIT = "CASE field_name WHEN 'total_amount' THEN 5.0 WHEN 'invoice_number' THEN 4.0 WHEN 'date' THEN 3.0 WHEN 'vendor_name' THEN 2.0 ELSE 1.0 END"
_QUEUE = f"SELECT id, document_id, field_name, status, confidence, risk, review, CASE WHEN review THEN CASE WHEN status = 'invalid' THEN 'validation_failed' WHEN confidence IS NULL THEN 'missing_confidence' WHEN w > 1 THEN 'critical_field' ELSE 'low_confidence' END END AS reason FROM (SELECT *, CASE WHEN confidence IS NULL THEN CAST('inf' AS DOUBLE) ELSE round(greatest(0.0, 1 - confidence) * w, 6) END AS risk, status = 'invalid' OR confidence IS NULL OR confidence < greatest(0.5, least(0.99, 1 - 0.1 / w)) AS review FROM (SELECT *, CAST({_CRIT} AS DOUBLE) AS w FROM ap_fields))"
add("f14_review_queue", _ap(R.review_queue), _QUEUE, "ap_fields")
add("a23_hitl_totals", _ap(lambda ap: R.hitl_totals(R.review_queue(ap))), f"SELECT document_id, count(*) AS total, count(*) FILTER (review) AS shown, count(*) FILTER (NOT review) AS skipped, round(coalesce(sum(risk) FILTER (NOT review), 0.0), 6) AS residual FROM ({_QUEUE}) GROUP BY document_id", "ap_fields")
_TRACE = "SELECT id, i, json_extract_string(e, '$.stage') AS stage, CAST(json_extract_string(e, '$.ok') AS BOOLEAN) AS ok, json_extract_string(e, '$.reason') AS reason, TRY_CAST(json_extract_string(e, '$.detail.elapsed_ms') AS DOUBLE) AS ms, TRY_CAST(json_extract_string(e, '$.detail.confidence') AS DOUBLE) AS conf FROM (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS e FROM (SELECT id, CAST(json_extract(traceability_log, '$[*]') AS JSON[]) AS l FROM ap_documents))"
add("a24_trace_stats", _ap(A.trace_stats), f"SELECT stage, reason, count(*) AS entries, round(avg(CAST(ok AS INTEGER)), 4) AS ok_share, quantile_cont(ms, 0.5) AS median_ms FROM ({_TRACE}) GROUP BY stage, reason", "ap_documents")
add("a24_last_confidence", _ap(A.last_confidence), f"SELECT id AS document_id, max_by(conf, i) AS confidence FROM ({_TRACE}) WHERE conf IS NOT NULL GROUP BY id", "ap_documents")

# Feeds, listings, corrections
add("s1_load_ledger", lambda s, d: view(s, d, "ap_fields").groupBy("field_name", "status").agg(F.count("*").alias("fields"), F.sum("k").alias("k")), "SELECT field_name, status, count(*) AS fields, CAST(sum(k) AS BIGINT) AS k FROM ap_fields GROUP BY field_name, status", "ap_fields")


def _bi(spark: SparkSession, sf: str) -> DataFrame:
    ap = sales_ledger(spark, sf)
    df = D.bi_invoices(ap, A.trust_scores(ap))
    return df.withColumns({c: _ts(c) for c in ("uploaded_at", "processed_at", "approved_at")})


QUERIES["s2_bi_invoices"] = _bi
SQL["s2_bi_invoices"] = _with_trust(f"SELECT d.id AS document_id, original_filename, status, fallback_tier, confidence_score, {_stamp('uploaded_at')} AS uploaded_at, {_stamp('processed_at')} AS processed_at, {_stamp('approved_at')} AS approved_at, vendor_name, trust_score, priority, {_num('bi')} AS amount FROM ap_documents d LEFT JOIN (SELECT document_id, vendor_name, replace(replace(total_amount, ',', ''), '$', '') AS bi FROM ({_VALUES})) v ON v.document_id = d.id LEFT JOIN (SELECT document_id, trust_score, priority FROM trust) t ON t.document_id = d.id")
add("s3_bi_line_items", _ap(D.bi_line_items), "SELECT document_id, description, quantity, unit_price, total FROM ap_line_items", "ap_line_items")
add("s4_bi_corrections", lambda s, d: D.bi_corrections(sales_ledger(s, d)).withColumn("created_at", _ts("created_at")), f"SELECT c.document_id, field_name, original_value, corrected_value, reviewed_by, {_stamp('c.created_at')} AS created_at FROM ap_corrections c LEFT JOIN ap_fields f ON f.id = c.field_id", "ap_corrections", "ap_fields")
add("p9_document_corrections", lambda s, d: D.document_corrections(sales_ledger(s, d)).withColumn("created_at", _ts("created_at")), f"SELECT document_id, field_id, original_value, corrected_value, reviewed_by, {_stamp('created_at')} AS created_at FROM ap_corrections", "ap_corrections")


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = view(spark, sf, "ap_documents").where("batch_id is not null")
    return docs.select("batch_id", F.when(F.col("k") % 41 == 0, F.concat("id", F.lit(".exe"))).otherwise(F.col("original_filename")).alias("filename"), (F.col("file_size") * 600).alias("size"))


add("s10_admit_batches", lambda s, d: D.admit_batches(_manifest(s, d)), "SELECT batch_id, count(*) AS files, count(*) FILTER (k % 41 = 0 OR file_size * 600 > 52428800) AS rejected, count(*) FILTER (k % 41 = 0 OR file_size * 600 > 52428800) = 0 AND count(*) BETWEEN 1 AND 20 AS admitted FROM ap_documents WHERE batch_id IS NOT NULL GROUP BY batch_id", "ap_documents")


def _spend_and_updates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    target = A.spend_by_month(sales_ledger(spark, sf)).select(F.lit("spend").alias("metric_name"), F.when(F.col("month") != "1995-05", F.col("month")).alias("period"), F.col("total_spend").alias("metric_value"))
    updates = A.spend_by_month(sales_ledger(spark, sf)).where("month like '1995%'").select(F.lit("spend").alias("metric_name"), F.when(F.col("month") != "1995-05", F.col("month")).alias("period"), (F.col("documents") * 1.0).alias("metric_value"), F.col("month").alias("at"))
    return target, updates


def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    return D.upsert(*_spend_and_updates(spark, sf), ["metric_name", "period"], "at")


def _committed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same, as two writes of a stored table."""
    target, updates = _spend_and_updates(spark, sf)
    table = KeyedTable(spark, shared_folder(spark, "spend"), "metric_name string, period string, metric_value double", ["metric_name", "period"])
    table.upsert(target)
    table.upsert(updates)
    return table.read()


def _committed_replace(spark: SparkSession, sf: str) -> DataFrame:
    fields = view(spark, sf, "ap_fields")
    table = KeyedTable(spark, shared_folder(spark, "fields"), "document_id string, id string, field_value string", ["document_id", "id"], bucket_by=["document_id"])
    table.upsert(fields)
    table.replace(fields.where("k % 10 = 3 and i = 1").select("document_id", "id", F.lit("new").alias("field_value")), ["document_id"])
    return table.read()


add("s11_upsert", _upsert, f"SELECT 'spend' AS metric_name, CASE WHEN month <> '1995-05' THEN month END AS period, CASE WHEN month LIKE '1995%' THEN documents * 1.0 ELSE total_spend END AS metric_value FROM ({_MONTH})", "ap_documents", "ap_fields")
add("s12_replace_for_documents", lambda s, d: D.replace_for_documents(view(s, d, "ap_fields").select("document_id", "id", "field_value"), view(s, d, "ap_fields").where("k % 10 = 3 and i = 1").select("document_id", "id", F.lit("new").alias("field_value"))), "SELECT document_id, id, field_value FROM ap_fields WHERE document_id NOT IN (SELECT document_id FROM ap_fields WHERE k % 10 = 3 AND i = 1) UNION ALL SELECT document_id, id, 'new' FROM ap_fields WHERE k % 10 = 3 AND i = 1", "ap_fields")
QUERIES["s11_committed_upsert"], SQL["s11_committed_upsert"] = _committed_upsert, SQL["s11_upsert"]
QUERIES["s12_committed_replace"], SQL["s12_committed_replace"] = _committed_replace, SQL["s12_replace_for_documents"]
add("s14_analytics_summaries", lambda s, d: A.analytics_summaries(A.spend_by_month(sales_ledger(s, d)).select(F.lit("spend").alias("metric_name"), F.col("total_spend").alias("metric_value"), F.col("month").alias("period")), "spend"), f"SELECT 'spend' AS metric_name, total_spend AS metric_value, month AS period FROM ({_MONTH})", "ap_documents", "ap_fields")
add("p1_list_documents", lambda s, d: D.list_documents(sales_ledger(s, d), "usr_7", include_all=True, skip=10, limit=25).withColumn("uploaded_at", _ts("uploaded_at")), f"SELECT id, original_filename, status, {_stamp('uploaded_at')} AS uploaded_at, (SELECT count(*) FROM ap_documents) AS total FROM (SELECT * FROM ap_documents ORDER BY uploaded_at DESC NULLS LAST, id LIMIT 25 OFFSET 10)", "ap_documents")
add("p2_display_status", lambda s, d: view(s, d, "ap_documents").select("id", D.display_status(F.when(F.col("k") % 13 == 0, "locally_parsed").when(F.col("k") % 13 == 1, "vlm_reconciled").when(F.col("k") % 13 == 2, "preprocessing").when(F.col("k") % 13 != 3, F.col("status"))).alias("shown")), "SELECT id, CASE k % 13 WHEN 0 THEN 'extracting' WHEN 1 THEN 'extracting' WHEN 2 THEN 'preprocessing' WHEN 3 THEN 'failed' ELSE CASE WHEN status = 'verified' THEN 'review_pending' ELSE status END END AS shown FROM ap_documents", "ap_documents")
_WIDE = f"SELECT document_id, invoice_number, date, vendor_name, subtotal, tax, total_amount FROM ({_VALUES})"
add("p3_invoice_wide", lambda s, d: D.invoice_wide(sales_ledger(s, d)).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0))).withColumn("first_item", F.get("items", F.lit(0))["description"]).drop("items"), f"SELECT v.*, coalesce(n_items, 0) AS n_items, first_item FROM ({_WIDE}) v LEFT JOIN (SELECT document_id, CAST(count(*) AS INTEGER) AS n_items, min_by(description, id) AS first_item FROM ap_line_items GROUP BY document_id) i USING (document_id)", "ap_fields", "ap_line_items")
add("p4_amounts", lambda s, d: view(s, d, "ap_fields").where("i = 6").select("id", amounts.amt_float(F.col("field_value")).alias("strict"), amounts.amt_bi(F.col("field_value")).alias("bi"), amounts.parse_amount(F.col("field_value")).cast("double").alias("currency")), f"SELECT id, {_num('field_value')} AS strict, {_num('bi')} AS bi, CAST(bi AS DOUBLE) AS currency FROM (SELECT id, field_value, replace(replace(field_value, ',', ''), '$', '') AS bi FROM ap_fields WHERE i = 6)", "ap_fields")
add("p5_requeue", _ap(D.requeue), "SELECT id, batch_id, status FROM ap_documents WHERE status IN ('uploaded', 'failed')", "ap_documents")
add("p6_list_batches", lambda s, d: D.list_batches(sales_ledger(s, d)).withColumn("created_at", _ts("created_at")), f"SELECT id, created_by, {_stamp('created_at')} AS created_at, status, total_documents FROM ap_batches ORDER BY ap_batches.created_at DESC, id LIMIT 5", "ap_batches")


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "ap_fields").where("k % 17 = 2 and i <= 2")
    j = spark.range(1, 3).select(F.col("id").cast("int").alias("j"))
    f = f.crossJoin(F.broadcast(j))  # two rows
    return f.select(F.concat(F.lit("e_"), "id", F.lit("_"), F.col("j").cast("string")).alias("id"), F.when(F.col("k") % 5 == 0, "doc_0").otherwise(F.col("document_id")).alias("document_id"), F.col("id").alias("field_id"), F.concat(F.lit("v"), F.col("j").cast("string")).alias("corrected_value"), F.lit("usr_1").alias("reviewed_by"), F.col("created_at"))


_GOOD = "k % 17 = 2 AND i <= 2 AND (k % 5 <> 0 OR document_id = 'doc_0')"
add("p7_apply_corrections", lambda s, d: D.apply_corrections(sales_ledger(s, d), _edits(s, d))[1].select("id", "field_id", "original_value", "corrected_value"), f"SELECT 'e_' || id || '_' || j AS id, id AS field_id, CASE j WHEN 1 THEN field_value ELSE 'v1' END AS original_value, 'v' || j AS corrected_value FROM ap_fields, (VALUES (1), (2)) x(j) WHERE {_GOOD}", "ap_fields")
add("p7_corrected_fields", lambda s, d: D.apply_corrections(sales_ledger(s, d), _edits(s, d))[0].select("id", "field_value", "status"), f"SELECT id, CASE WHEN {_GOOD} THEN 'v2' ELSE field_value END AS field_value, CASE WHEN {_GOOD} THEN 'corrected' ELSE status END AS status FROM ap_fields", "ap_fields")
_AT = "2000-01-01 00:00:00"
add("p8_approve", lambda s, d: D.approve(sales_ledger(s, d), view(s, d, "ap_documents").where("status = 'verified'").select(F.col("id").alias("document_id"), F.lit("usr_9").alias("user")), _AT).withColumn("approved_at", _ts("approved_at")), f"SELECT d.id, all_resolved AS allowed, CASE WHEN all_resolved THEN 'approved' ELSE status END AS status, CASE WHEN all_resolved THEN 'usr_9' ELSE approved_by END AS approved_by, CASE WHEN all_resolved THEN '{_AT}' ELSE {_stamp('approved_at')} END AS approved_at FROM ap_documents d JOIN ({_SUMMARY}) s ON s.document_id = d.id WHERE status = 'verified'", "ap_documents", "ap_fields")
add("p10_merge_tiers", lambda s, d: D.merge_tiers(view(s, d, "ap_fields").where("i <> 3"), view(s, d, "ap_fields").where("k % 4 = 1").select("document_id", "field_name", F.concat(F.lit("s"), "field_value").alias("field_value"), (F.col("k") % 90 / 100).alias("confidence")), s.createDataFrame([("date", 0.8)], "field_name string, threshold double")), """
  SELECT document_id, field_name, CASE WHEN take THEN s_value ELSE f_value END AS field_value, CASE WHEN take THEN s_conf ELSE f_conf END AS confidence, CASE WHEN take THEN 'second' ELSE 'fast' END AS source FROM
  (SELECT *, f_value IS NULL OR (s_value IS NOT NULL AND coalesce(f_conf, 1.0) < CASE WHEN field_name = 'date' THEN 0.8 ELSE 0.5 END AND coalesce(s_conf, 0.0) > coalesce(f_conf, 0.0)) AS take FROM
   (SELECT document_id, field_name, field_value AS f_value, confidence AS f_conf FROM ap_fields WHERE i <> 3) f FULL JOIN (SELECT document_id, field_name, 's' || field_value AS s_value, (k % 90) / 100.0E0 AS s_conf FROM ap_fields WHERE k % 4 = 1) s USING (document_id, field_name))""", "ap_fields")
add("p10_merge_items", lambda s, d: D.merge_items(view(s, d, "ap_line_items").select("document_id", "description", "total"), view(s, d, "ap_line_items").where("total > 50000").select("document_id", F.lit("second").alias("description"), "total")), "SELECT document_id, description, total FROM ap_line_items WHERE document_id NOT IN (SELECT document_id FROM ap_line_items WHERE total > 50000) UNION ALL SELECT document_id, 'second', total FROM ap_line_items WHERE total > 50000", "ap_line_items")
add("j1_clean_documents", lambda s, d: D.clean_documents(sales_ledger(s, d), 200).withColumn("processed_at", _ts("processed_at")), f"SELECT id AS document_id, {_stamp('processed_at')} AS processed_at FROM (SELECT * FROM ap_documents d WHERE status = 'verified' AND id NOT IN (SELECT document_id FROM ap_corrections) AND id IN (SELECT document_id FROM ap_fields) ORDER BY processed_at DESC NULLS LAST, id LIMIT 200)", *_ALL)
_EARLY = "SELECT field_id, arg_min(original_value, id) AS original_value, arg_min(corrected_value, id) AS corrected_value, min(created_at) AS created_at, min(document_id) AS document_id FROM ap_corrections GROUP BY field_id"
add("w1_earliest_correction", lambda s, d: D.earliest_correction(sales_ledger(s, d).corrections).withColumn("created_at", _ts("created_at")), f"SELECT field_id, original_value, corrected_value, {_stamp('created_at')} AS created_at, document_id FROM ({_EARLY})", "ap_corrections")
_PAIR = ", ".join(f"min_by({c}, id) FILTER (field_name = '{n}') AS {w}_{n}" for n in ("invoice_number", "date", "vendor_name", "subtotal", "tax", "total_amount") for w, c in (("before", "before"), ("after", "field_value")))
add("j2_correction_pairs", lambda s, d: D.correction_pairs(sales_ledger(s, d), 500), f"SELECT document_id, {_PAIR} FROM (SELECT f.*, coalesce(e.original_value, field_value) AS before FROM ap_fields f LEFT JOIN ({_EARLY}) e ON e.field_id = f.id WHERE f.document_id IN (SELECT DISTINCT document_id FROM ap_corrections ORDER BY 1 LIMIT 500)) GROUP BY document_id", "ap_fields", "ap_corrections")
add("j3_correction_text_pairs", lambda s, d: D.correction_text_pairs(sales_ledger(s, d), 500), f"SELECT field_id, coalesce(fallback_tier, 'unknown') AS tier, field_name, original_value AS model_value, corrected_value AS human_value FROM ({_EARLY}) e JOIN (SELECT id AS field_id, field_name FROM ap_fields) f USING (field_id) JOIN ap_documents d ON d.id = e.document_id ORDER BY e.created_at DESC, field_id LIMIT 500", *_ALL)
_NEW = "ORDER BY processed_at DESC NULLS LAST, id LIMIT 100"
add("j4_holdouts", lambda s, d: D.holdouts(sales_ledger(s, d), 100), f"SELECT id AS document_id, 'corrected' AS kind FROM (SELECT * FROM ap_documents WHERE id IN (SELECT document_id FROM ap_corrections) {_NEW}) UNION ALL SELECT id, 'clean' FROM (SELECT * FROM ap_documents WHERE status = 'verified' AND id NOT IN (SELECT document_id FROM ap_corrections) {_NEW})", *_ALL)
# The same without a limit: all there is to train on.
add("j1_clean_documents_all", lambda s, d: D.clean_documents(sales_ledger(s, d)).withColumn("processed_at", _ts("processed_at")), f"SELECT id AS document_id, {_stamp('processed_at')} AS processed_at FROM ap_documents WHERE status = 'verified' AND id NOT IN (SELECT document_id FROM ap_corrections) AND id IN (SELECT document_id FROM ap_fields)", *_ALL)
add("j2_correction_pairs_all", lambda s, d: D.correction_pairs(sales_ledger(s, d)), f"SELECT document_id, {_PAIR} FROM (SELECT f.*, coalesce(e.original_value, field_value) AS before FROM ap_fields f LEFT JOIN ({_EARLY}) e ON e.field_id = f.id WHERE f.document_id IN (SELECT document_id FROM ap_corrections)) GROUP BY document_id", "ap_fields", "ap_corrections")
add("j3_correction_text_pairs_all", lambda s, d: D.correction_text_pairs(sales_ledger(s, d)), f"SELECT field_id, coalesce(fallback_tier, 'unknown') AS tier, field_name, original_value AS model_value, corrected_value AS human_value FROM ({_EARLY}) e JOIN (SELECT id AS field_id, field_name FROM ap_fields) f USING (field_id) JOIN ap_documents d ON d.id = e.document_id", *_ALL)

# Files: what a job wrote to the shared folder is read back
def _csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    S.write_csv(D.bi_line_items(sales_ledger(spark, sf)), path)
    return spark.read.option("header", True).schema("document_id string, description string, quantity double, unit_price double, total double").csv(path)


add("s6_csv_line_items", _csv, "SELECT document_id, description, CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(total AS DOUBLE) AS total FROM ap_line_items", "ap_line_items")


def _labels_of_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A label file for each supplier, as JSON or lines, and an image for most: written by tasks."""
    path = shared_folder(spark, "receipts")
    k, name = F.col("s_suppkey"), F.col("s_name")
    lines = F.concat(F.lit("Company\t"), name, F.lit("\nDATE: 1998-01-02\n total:"), k.cast("string"), F.lit("\nnote:\n"))
    body = F.when(k % 2 == 0, F.to_json(F.struct(name.alias("company"), F.lit("1998-01-02").alias("Date"), k.cast("string").alias("total"), F.lit("").alias("note")))).otherwise(lines)
    label, image = F.concat(F.lit("labels/s"), k.cast("string"), F.lit(".txt")), F.concat(F.lit("images/s"), k.cast("string"), F.lit(".png"))
    files = view(spark, sf, "supplier").select(F.explode(F.array(F.struct(label.alias("name"), body.alias("body")), F.struct(F.when(k % 5 != 0, image).alias("name"), F.lit("x").alias("body")))).alias("f")).select("f.*").where("name is not null")
    S.write_small_files(files, path)
    got = S.read_receipt_labels(spark, f"{path}/images", f"{path}/labels")
    return got.select("sample", *[F.try_element_at("fields", F.lit(c)).alias(c) for c in ("vendor_name", "date", "total_amount", "note")])


add("s7_receipt_labels", _labels_of_suppliers, "SELECT 's' || s_suppkey AS sample, s_name AS vendor_name, '1998-01-02' AS date, CAST(s_suppkey AS VARCHAR) AS total_amount, CAST(NULL AS VARCHAR) AS note FROM supplier WHERE s_suppkey % 5 <> 0")


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    wide = D.invoice_wide(sales_ledger(spark, sf))
    item = lambda x: F.struct(x["description"].alias("nm"), x["quantity"].alias("cnt"), x["unit_price"].alias("unitprice"), x["total"].alias("price"))
    menu = F.when(F.size("items") == 1, F.to_json(item(F.get("items", F.lit(0))))).otherwise(F.to_json(F.transform("items", item)))
    rest = F.to_json(F.struct(F.struct(F.col("subtotal").alias("subtotal_price"), F.col("tax").alias("tax_price")).alias("sub_total"), F.struct(F.col("total_amount").alias("total_price")).alias("total")))
    truth = F.concat(F.lit('{"gt_parse": {"menu": '), F.coalesce(menu, F.lit("[]")), F.lit(", "), F.substring(rest, 2, 1 << 20), F.lit("}"))
    got = S.parse_nested_truth(wide.select("document_id", truth.alias("ground_truth")))
    return got.select("document_id", "subtotal", "tax", "total_amount", F.size("items").alias("n_items"), F.get("items", F.lit(0))["description"].alias("first_item"))


add("s8_nested_truth", _nested, f"SELECT document_id, subtotal, tax, total_amount, coalesce(n_items, 0) AS n_items, first_item FROM ({_VALUES}) v LEFT JOIN (SELECT document_id, CAST(count(*) AS INTEGER) AS n_items, min_by(description, id) AS first_item FROM ap_line_items GROUP BY document_id) i USING (document_id)", "ap_fields", "ap_line_items")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "log")
    f = view(spark, sf, "ap_fields").where("i = 6")
    at = F.concat(F.lit("2025-01-0"), (F.col("k") % 9 + 1).cast("string"))
    entry = lambda when, text: f.select(when.alias("timestamp"), F.concat(F.lit("f"), (F.col("k") % 1000).cast("string")).alias("file"), F.create_map("field_name", "field_value").alias("fields"), text.alias("raw_text"))
    entry(at, F.col("id")).unionByName(entry(F.lit("2024-12-31"), F.lit("old"))).write.json(path)
    return S.read_prediction_log(spark, path).select("file", "timestamp", "raw_text", F.try_element_at("fields", F.lit("total_amount")).alias("total_amount"))


add("s9_prediction_log", _log, "SELECT file, max(timestamp) AS timestamp, max_by(id, (timestamp, id)) AS raw_text, max_by(field_value, (timestamp, id)) AS total_amount FROM (SELECT '2025-01-0' || (k % 9 + 1) AS timestamp, 'f' || (k % 1000) AS file, id, field_value FROM ap_fields WHERE i = 6) GROUP BY file", "ap_fields")


def _saved_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "thresholds")
    learned = view(spark, sf, "ap_fields").where("status <> 'invalid' and confidence is not null").groupBy("field_name").agg(F.round(F.min("confidence") + 0.1, 4).alias("threshold"))
    S.save_thresholds(learned.where("field_name <> 'date'"), f"{path}/now")
    S.save_thresholds(learned, f"{path}/old", version=S.VERSION - 1)  # of another version: none of it is read
    saved = S.load_thresholds(spark, f"{path}/now").unionByName(S.load_thresholds(spark, f"{path}/old"))
    return R.review_queue(sales_ledger(spark, sf), saved).where("review").groupBy("field_name").agg(F.count("*").alias("reviewed"))


add("s13_thresholds", _saved_thresholds, f"SELECT field_name, count(*) AS reviewed FROM (SELECT *, CASE field_name WHEN 'total_amount' THEN 5.0 WHEN 'invoice_number' THEN 4.0 WHEN 'date' THEN 3.0 WHEN 'vendor_name' THEN 2.0 ELSE 1.0 END AS w FROM ap_fields) f LEFT JOIN (SELECT field_name, round(min(confidence) + 0.1, 4) AS t FROM ap_fields WHERE status <> 'invalid' AND confidence IS NOT NULL AND field_name <> 'date' GROUP BY 1) l USING (field_name) WHERE status = 'invalid' OR confidence IS NULL OR confidence < greatest(coalesce(t, 0.5), least(0.99, 1 - 0.1 / w)) GROUP BY 1", "ap_fields")
add("p8_reject", lambda s, d: D.reject(sales_ledger(s, d), view(s, d, "ap_documents").where("status = 'review_pending'").select(F.col("id").alias("document_id"), F.lit("blurred").alias("reason"))), "SELECT id, 'rejected' AS status, 'blurred' AS rejected_reason FROM ap_documents WHERE status = 'review_pending'", "ap_documents")

# Row rules
_CUR = "CASE WHEN regexp_matches({0}, '^-?\\d+(\\.\\d+)?$') THEN TRY_CAST({0} AS DECIMAL(38,6)) END"
_BARE = "replace(field_value, '$', '')"
add("f1_parse_amount", lambda s, d: view(s, d, "ap_fields").where("i >= 4").select("id", amounts.parse_amount(F.col("field_value")).cast("double").alias("amount"), amounts.amount_error(F.col("field_value")).alias("error")), f"SELECT id, CAST({_CUR.format(_BARE)} AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS error FROM ap_fields WHERE i >= 4", "ap_fields")
_DEC = {c: _CUR.format(f"replace({c}, '$', '')") for c in ("subtotal", "tax", "total_amount")}
_AUDIT = f"""SELECT document_id, total, subtotal_amt, tax_amt, items_total, CASE WHEN coalesce(total_amount, '') <> '' AND total IS NULL THEN 'unreadable_total' WHEN total IS NULL THEN 'missing_total' WHEN subtotal_amt IS NULL OR tax_amt IS NULL THEN 'partial_data' WHEN abs(subtotal_amt + tax_amt - total) > 0.01 THEN 'math_mismatch' END AS audit_reason
  FROM (SELECT document_id, total_amount, {_DEC['total_amount']} AS total, {_DEC['subtotal']} AS subtotal_amt, {_DEC['tax']} AS tax_amt FROM ({_VALUES})) v LEFT JOIN ({_ITEMS}) i USING (document_id)"""
_OK = "(audit_reason IS NULL OR audit_reason = 'partial_data')"
add("f2_audit", lambda s, d: R.audits(sales_ledger(s, d)).select("document_id", F.col("total").cast("double").alias("total"), F.col("delta").cast("double").alias("delta"), "audit_reason", "audit_ok"), f"SELECT document_id, CAST(total AS DOUBLE) AS total, CAST(subtotal_amt + tax_amt - total AS DOUBLE) AS delta, audit_reason, {_OK} AS audit_ok FROM ({_AUDIT})", "ap_fields", "ap_line_items")


def _slip_sql(fallback: str = "") -> str:
    near = lambda left, right: f"CASE WHEN {right} = 0 THEN abs({left}) <= 0.01 ELSE abs({left} - {right}) * 100 <= abs({right}) END"
    s, t, total = "CAST(subtotal_amt AS DOUBLE)", "CAST(tax_amt AS DOUBLE)", "CAST(total AS DOUBLE)"
    cases = []
    for r in audit.RATIOS:
        cases += [f"WHEN {s} <> 0 AND {near(f'({s} * {r} + {t})', total)} THEN 'subtotal {r}'", f"WHEN {t} <> 0 AND {near(f'({s} + {t} * {r})', total)} THEN 'tax {r}'", f"WHEN {near(f'(({s} + {t}) * {r})', total)} THEN 'total {r}'"]
    cases += [f"WHEN items_total <> 0 AND abs({total} - items_total * {r}) * 100 <= abs(items_total * {r}) * 5 THEN 'total {r}{fallback}'" for r in audit.RATIOS]
    return f"SELECT document_id, CASE WHEN audit_reason = 'math_mismatch' THEN CASE {' '.join(cases)} END END AS slip FROM ({_AUDIT})"


add("f3_magnitude_slip", lambda s, d: R.audits(sales_ledger(s, d)).select("document_id", F.when(F.col("slip_field").isNotNull(), F.concat_ws(" ", "slip_field", "slip_ratio")).alias("slip")), _slip_sql(), "ap_fields", "ap_line_items")
_SLIPS = {f"{field} {r}": ("too small" if (float(r) > 1) == (field != "total") else "too large") for field in audit.SLIP_FIELDS for r in audit.RATIOS}
_PLAIN = lambda c: f"replace(replace({c}, '$', ''), ',', '')"
_TEXTS = " ".join(f"WHEN '{k}' THEN 'magnitude_error: likely decimal-point slip in {k.split()[0]} \u2014 reported {k.split()[0]} appears {way} by a factor of ~{k.split()[1]} relative to the other two fields. Observed: subtotal=' || {_PLAIN('subtotal')} || ', tax=' || {_PLAIN('tax')} || ', total=' || {_PLAIN('total_amount')} || '. Re-scan the {k.split()[0]} field digit by digit and verify decimal placement before returning a value.'" for k, way in _SLIPS.items())
_TEXTS += " ".join(f" WHEN 'total {r} items' THEN 'magnitude_error: the reported total (' || {_PLAIN('total_amount')} || ') is ~{r}x the sum of line items (' || CAST(CAST(items_total AS DECIMAL(18,2)) AS VARCHAR) || '). The subtotal+tax triangulation was inconclusive, so a line item may also be mis-extracted. Re-scan every line item''s amount and the total field, verifying decimal placement.'" for r in audit.RATIOS)
_WAYS = " ".join(f"WHEN '{k}' THEN '{way.replace(' ', '_')}'" for k, way in _SLIPS.items())
add("f3_slip_text", lambda s, d: audit.slip_sentence(R.audits(sales_ledger(s, d)), "items_total").where("slip_field is not null").select("document_id", "slip_field", "slip_ratio", "slip_direction", "slip_text"), f"SELECT document_id, split_part(slip, ' ', 1) AS slip_field, split_part(slip, ' ', 2) AS slip_ratio, CASE slip {_WAYS} END AS slip_direction, CASE slip {_TEXTS} END AS slip_text FROM ({_slip_sql(' items')}) s JOIN ({_VALUES}) v USING (document_id) LEFT JOIN ({_ITEMS}) i USING (document_id) WHERE slip IS NOT NULL", "ap_fields", "ap_line_items")
_VALID = f"""SELECT id, document_id, field_name, field_value, CASE WHEN field_name IN ('invoice_number', 'date', 'vendor_name', 'total_amount') AND trim(coalesce(field_value, '')) = '' THEN field_name || ' is required' WHEN trim(coalesce(field_value, '')) = '' THEN NULL
  WHEN field_name = 'invoice_number' AND NOT regexp_matches(field_value, '^INV-\\d{{4}}-\\d{{4}}$') THEN 'Invoice number must match INV-YYYY-NNNN' WHEN field_name = 'date' AND TRY_CAST(field_value AS DATE) IS NULL THEN 'Date must be YYYY-MM-DD'
  WHEN field_name IN ('total_amount', 'subtotal', 'tax') AND ({_num('field_value')}) IS NULL THEN field_name || ' must be a number' END AS error_message FROM ap_fields"""
add("f4_validate_fields", lambda s, d: R.validate_fields(sales_ledger(s, d)).select("id", "status", "error_message"), f"SELECT id, CASE WHEN error_message IS NULL THEN 'valid' ELSE 'invalid' END AS status, error_message FROM ({_VALID})", "ap_fields")
add("f5_reconcile", lambda s, d: R.reconcile(sales_ledger(s, d)).select("id", "status", "error_message"), f"""SELECT v.id, CASE WHEN off OR error_message IS NOT NULL THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN off THEN printf('Line items sum %.2f does not match total %.2f', CAST(items_total AS DOUBLE), amount) ELSE error_message END AS error_message
  FROM (SELECT v.*, items_total, {_num('field_value')} AS amount, coalesce(field_name = 'total_amount' AND abs(CAST(items_total AS DOUBLE) - ({_num('field_value')})) >= 0.01, false) AS off FROM ({_VALID}) v LEFT JOIN ({_ITEMS}) i ON i.document_id = v.document_id) v""", "ap_fields", "ap_line_items")
add("f6_parse_date_any", lambda s, d: view(s, d, "ap_documents").select("id", F.date_format(amounts.parse_date_any(F.coalesce(*[F.when(F.col("k") % 12 == i, F.date_format("uploaded_at", f)) for i, (f, _) in enumerate(amounts.DATE_FORMATS)], F.lit("no date"))), "yyyy-MM-dd").alias("day")), """SELECT id, CASE WHEN k % 12 = 11 THEN NULL WHEN k % 12 IN (2, 4) AND day(uploaded_at) <= 12 THEN printf('%04d-%02d-%02d', year(uploaded_at), day(uploaded_at), month(uploaded_at)) ELSE strftime(uploaded_at, '%Y-%m-%d') END AS day FROM ap_documents""", "ap_documents")
add("f7_normalize_date", lambda s, d: view(s, d, "ap_documents").select("id", amounts.normalize_date(F.when(F.col("k") % 2 == 0, F.date_format("uploaded_at", "M/d/yyyy")).otherwise(F.date_format("uploaded_at", "MMMM d, yyyy"))).alias("day")), "SELECT id, strftime(uploaded_at, '%Y-%m-%d') AS day FROM ap_documents", "ap_documents")
_AMT = r"(?:\$|€|£)?\s*([\d,]+\.\d{1,2})"
_RX = {"invoice_number": r"(?i)invoice\s*(?:no\.?|number|#)[:\s]*([A-Z0-9\-/]+)", "date": r"\b(\d{4}-\d{2}-\d{2})\b", "total_amount": rf"(?i)(?:grand|invoice)\s+total[^\n\r]{{0,60}}?{_AMT}", "subtotal": rf"(?i)sub[-\s]?total[^\n\r]{{0,60}}?{_AMT}", "tax": rf"(?i)(?:tax|vat|gst|sales\s*tax)[^\n\r]{{0,60}}?{_AMT}", "vendor_name": r"(?im)^\s*(?:vendor|supplier|from)[:\s]+(.+?)$"}
add("f8_extract_fields", lambda s, d: view(s, d, "ap_receipts").select("document_id", *[c.alias(n) for n, c in extract.extract_fields(F.col("text")).items()]), "SELECT document_id, " + ", ".join(f"nullif(trim(regexp_extract(text, '{rx}', 1)), '') AS {n}" for n, rx in _RX.items()) + " FROM ap_receipts", "ap_receipts")
_MATCH = lambda n: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in extract.RECEIPT[n]) + ")"
_RECEIPT_TOTALS = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in extract.TOTALS)
add("f9_extract_receipt", lambda s, d: view(s, d, "ap_receipts").select("document_id", *[c.alias(n) for n, c in extract.extract_receipt(F.col("text")).items()]), f"SELECT document_id, 'ACME STORES' AS merchant_name, CAST(NULL AS VARCHAR) AS currency, printf('%.2f', list_max(list_transform(flatten([{_RECEIPT_TOTALS}]), lambda v: CAST(replace(v, ',', '') AS DOUBLE)))) AS total_amount, " + ", ".join(f"{_MATCH(n)} AS {n}" for n in extract.RECEIPT) + " FROM ap_receipts", "ap_receipts")

_NO_WORD_BEFORE = lambda p: p.replace(r"(?<!\w)", r"(?:^|\W)")  # noqa: E731  # the other engine's patterns don't look behind
_KEYED = lambda n: f"nullif(replace(regexp_extract(t, '(?i){_NO_WORD_BEFORE(extract.AMOUNT_WORDS[n])}[:\\s]*{extract.KEYED_AMOUNT}', 1), ',', ''), '')"
#: Receipts of which some have lost the words before their amounts or their date, or have the date in another form.
_KEYED_TEXTS = "SELECT document_id, CASE k % 4 WHEN 0 THEN replace(replace(replace(text, 'Grand Total', 'Sum'), 'Subtotal', 'Net'), 'Date: ', 'on ') WHEN 1 THEN replace(replace(text, 'Grand Total', 'Balance Due'), 'Invoice No: ', 'Number ') WHEN 2 THEN replace(text, 'Date: ', 'Due Date 3/14/2024 of ') ELSE text END AS t FROM {ap_receipts}"
add("f9_extract_keyed", lambda s, d: s.sql(_KEYED_TEXTS, ap_receipts=view(s, d, "ap_receipts")).select("document_id", *[c.alias(n) for n, c in extract.extract_keyed(F.col("t")).items()]), f"""SELECT *, CASE WHEN invoice_number IS NOT NULL THEN 0.92E0 END AS invoice_number_confidence, CASE WHEN total_amount IS NOT NULL THEN 0.88E0 END AS total_amount_confidence, CASE WHEN subtotal IS NOT NULL THEN 0.88E0 END AS subtotal_confidence, CASE WHEN tax IS NOT NULL THEN 0.88E0 END AS tax_confidence
  FROM (SELECT document_id, nullif(regexp_extract(t, '{extract.KEYED_INVOICE}', 0), '') AS invoice_number, CASE WHEN regexp_matches(t, 'Due Date 3/') THEN CASE WHEN regexp_matches(t, '{extract.DATE_WORDS}\\d{{4}}-') THEN NULL ELSE '2024-03-14' END ELSE nullif(regexp_extract(t, '{extract.KEYED_DATES[0]}'), '') END AS date,
    CASE WHEN regexp_matches(t, '{extract.DATE_WORDS}\\d') THEN 0.93E0 WHEN regexp_matches(t, '{extract.KEYED_DATES[0]}') THEN 0.90E0 END AS date_confidence,
    coalesce({_KEYED("total_amount")}, printf('%.2f', list_max(list_transform(regexp_extract_all(t, '{extract.KEYED_AMOUNT}', 1), lambda v: CAST(replace(v, ',', '') AS DOUBLE))))) AS total_amount, {_KEYED("subtotal")} AS subtotal, {_KEYED("tax")} AS tax FROM ({_KEYED_TEXTS.format(ap_receipts="ap_receipts")}))""", "ap_receipts")


def _table_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items read back from tables of text that stand for each document's items: headers in two orders, one without a description, amounts with marks."""
    cell = {"description": F.col("description"), "quantity": F.col("quantity").cast("string"), "unit_price": F.format_string("$%.2f", "unit_price"), "total": F.format_number("total", 2)}
    kind = F.pmod(F.substring("document_id", 5, 20).cast("long"), F.lit(3))
    row = lambda *names: F.array(*[F.concat(F.lit(" "), cell[n]) if n in cell else F.lit(n) for n in names])
    cells = F.when(kind == 0, row("description", "quantity", "unit_price", "total")).when(kind == 1, row("1", "total", "unit_price", "x", "description")).otherwise(row("quantity", "total"))
    heads = {0: ("Description", "Qty", "Unit Price", "Total"), 1: ("No", "Line total", " RATE", "Remark", "Product"), 2: ("Units", "Amount")}
    head = F.when(F.col("kind") == 0, F.array(*map(F.lit, heads[0]))).when(F.col("kind") == 1, F.array(*map(F.lit, heads[1]))).otherwise(F.array(*map(F.lit, heads[2])))
    rows = view(spark, sf, "ap_line_items").select("document_id", kind.alias("kind"), "id", cells.alias("cells"))
    body = rows.groupBy("document_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "cells"))), lambda x: x["cells"]).alias("body"))
    tables = body.select("document_id", F.array(F.array(F.array(F.lit("Header only"))), F.concat(F.array(head), F.col("body"))).alias("tables"))
    return tables.select("document_id", F.posexplode(extract.items_from_tables(F.col("tables"))).alias("pos", "item")).select("document_id", "pos", "item.*")


add("f9_table_items", _table_items, """SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS INTEGER) AS pos, description, CASE WHEN k % 3 = 0 THEN CAST(quantity AS DOUBLE) ELSE 0.0 END AS quantity, CAST(printf('%.2f', unit_price) AS DOUBLE) AS unit_price, CAST(printf('%.2f', total) AS DOUBLE) AS total
  FROM (SELECT *, CAST(substr(document_id, 5) AS BIGINT) AS k FROM ap_line_items) WHERE k % 3 <> 2""", "ap_line_items")


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Fields by precedence over receipts: given values for some, layout pairs for some, patterns, then triangulated amounts."""
    invoices = stored(view(spark, sf, "ap_invoices"), "extract-invoices")
    receipts, blocks = (spark.sql(VIEWS[n], ap_invoices=invoices) for n in ("ap_receipts", "ap_blocks"))
    df = receipts.join(L.document_fields(blocks, F.col("k") % 3 == 0), "document_id", "left")
    given = {"vendor_name": F.when(F.col("k") % 4 == 1, "given vendor"), "tax": F.when(F.col("k") % 4 == 1, " ")}
    known = extract.extract_all(F.col("text"), given, {n: F.col(n) for n in extract.PATTERNS})
    found = {"total_amount": "found_total", "subtotal": "found_subtotal", "tax": "found_tax"}
    return df.select("document_id", *[c.alias(n) for n, c in known.items() if n not in found], *[L.filled(known[n], F.col(c)).alias(n) for n, c in found.items()])


add("f8_extract_all", _extracted, """SELECT r.document_id, CASE WHEN r.k % 4 = 1 THEN 'given vendor' WHEN (r.k % 3 = 0 AND (r.k + 1) % 9 <> 0) OR r.k % 5 <> 0 THEN i.vendor END AS vendor_name, CASE WHEN r.k % 3 = 0 AND (r.k + 2) % 9 <> 0 THEN 'INV-' || r.k ELSE 'INV-2025-' || substr(CAST(10000 + r.k % 10000 AS STRING), 2) END AS invoice_number,
  CASE WHEN (r.k % 3 = 0 AND (r.k + 3) % 9 <> 0) OR r.k % 7 <> 0 THEN CAST(i.day AS STRING) END AS date, CAST(CAST(i.subtotal + i.tax AS DECIMAL(18,2)) AS STRING) AS total_amount, CAST(i.subtotal AS STRING) AS subtotal, CASE WHEN r.k % 4 <> 0 OR (r.k % 3 = 0 AND (r.k + 5) % 9 <> 0) OR i.tax > 0 THEN CAST(i.tax AS STRING) END AS tax
  FROM ap_receipts r JOIN ap_invoices i ON i.k = r.k""", "ap_receipts", "ap_blocks", "ap_invoices")
add("f10_norm_text", lambda s, d: view(s, d, "ap_fields").select("id", text.norm_text(F.col("field_value")).alias("a"), text.norm_plain(F.col("field_value")).alias("b")), r"SELECT id, nullif(replace(trim(regexp_replace(regexp_replace(lower(trim(field_value)), '(?i)(rs\.?|pkr|inr|usd|\$|€|£|/-)', '', 'g'), '\s+', ' ', 'g')), ',', ''), '') AS a, trim(regexp_replace(lower(field_value), '\s+', ' ', 'g')) AS b FROM ap_fields", "ap_fields")


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ap_replies").select("document_id", text.parse_reply(F.col("reply")).alias("r")).select("document_id", "r.reason", *[f"r.{k}" for k in text.REPLY_KEYS], F.size("r.line_items").alias("n_items"))


_REPLY = r"SELECT document_id, k, b, CASE WHEN trim(reply) = '' THEN 'empty_output' WHEN b IS NULL THEN 'no_json_found' WHEN NOT json_valid(b) THEN 'json_decode_error' END AS reason FROM (SELECT document_id, k, reply, nullif(regexp_extract(reply, '(?s)(\{.*\})', 1), '') AS b FROM ap_replies)"
add("f11_parse_reply", _replies, f"SELECT document_id, reason, " + ", ".join(f"CASE WHEN reason IS NULL THEN json_extract_string(b, '$.{k}') END AS {k}" for k in ("invoice_number", "date", "vendor_name", "subtotal", "tax", "total_amount")) + f", CASE WHEN reason IS NULL AND k % 2 = 0 THEN 2 END AS n_items FROM ({_REPLY})", "ap_replies")
add("q9_parse_robustness", lambda s, d: Q.parse_robustness(view(s, d, "ap_replies")), f"SELECT coalesce(reason, 'ok') AS outcome, count(*) AS replies FROM ({_REPLY}) GROUP BY 1", "ap_replies")
#: The pairs of text_pairs in the other engine's SQL. Its levenshtein counts bytes: in a and b each letter outside ASCII that
#: occurs is one control character instead, so that it counts letters.
_LETTERS = "éóèñüçäöêßíÉÈÑÓÇÊÜÖÄÍ"
_ONE_BYTE = lambda c: f"translate({c}, '{_LETTERS}', " + " || ".join(f"chr({k})" for k in (*range(1, 9), 11, 12, *range(14, 32))[: len(_LETTERS)]) + ")"
_PAIRS_SQL = rf"""WITH cut AS MATERIALIZED (SELECT doc_id, unnest(parts) AS reference, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN [text] ELSE regexp_extract_all(text, '([^\n]{{0,79}}\n|[^\n]{{1,80}})', 1) END AS parts FROM documents)),
  ap_pairs AS MATERIALIZED (SELECT *, {_ONE_BYTE("coalesce(reference, '')")} AS a, {_ONE_BYTE("coalesce(hypothesis, '')")} AS b FROM (SELECT doc_id, pos, reference, CASE k % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'vlm' ELSE 'unknown' END AS tier, CASE k % 4 WHEN 0 THEN 'vendor_name' WHEN 1 THEN 'date' WHEN 2 THEN 'total_amount' ELSE 'invoice_number' END AS field_name,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN substr(reference, 1, CAST(greatest(length(reference) - 1 - k % 9, 0) AS INT)) WHEN k % 5 = 0 THEN replace(reference, 'e', 'c') WHEN k % 11 = 0 THEN '' ELSE reference END AS hypothesis FROM (SELECT *, coalesce(doc_id, 0) + pos AS k FROM cut))) """


def pairs(name: str, run: Query, sql: str) -> None:
    """A query over all text pairs of whole documents."""
    QUERIES[name], SQL[name] = run, _PAIRS_SQL + sql


#: Matches on the edit path of a and b. All paths have the same where there is at most one edit more than the lengths differ by, and
#: the path is the diagonal where each edit is a changed place; else the cells' (edits, matches), as edits x 1,000,000 + matches, row by row.
_CELLS = """list_reduce(range(1, length(a) + 1), lambda line, i: list_reduce(range(1, length(b) + 1), lambda found, j: list_append(found,
  CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN line[j] + 1 WHEN line[j] // 1000000 <= least(line[j + 1] // 1000000, found[j] // 1000000) THEN line[j] + 1000000
       WHEN line[j + 1] // 1000000 <= found[j] // 1000000 THEN line[j + 1] + 1000000 ELSE found[j] + 1000000 END), [CAST(i * 1000000 AS BIGINT)]), list_transform(range(length(b) + 1), lambda x: CAST(x * 1000000 AS BIGINT)))"""
_MATCHES = f"""CASE WHEN levenshtein(a, b) - abs(length(a) - length(b)) <= 1 THEN greatest(length(a), length(b)) - levenshtein(a, b)
  WHEN length(a) = length(b) THEN CASE WHEN hamming(a, b) = levenshtein(a, b) THEN length(a) - levenshtein(a, b) ELSE ({_CELLS})[-1] % 1000000 END ELSE ({_CELLS})[-1] % 1000000 END"""
#: Words of a reference and a hypothesis; in wa and wb each distinct one is one character.
_WORD = r"[^\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_IN_WORDS = f"SELECT * EXCLUDE (ws, hs), array_to_string(list_transform(ws, lambda x: chr(CAST(39 + list_position(list_distinct(list_concat(ws, hs)), x) AS INTEGER))), '') AS wa, array_to_string(list_transform(hs, lambda x: chr(CAST(39 + list_position(list_distinct(list_concat(ws, hs)), x) AS INTEGER))), '') AS wb FROM (SELECT *, regexp_extract_all(coalesce(reference, ''), '{_WORD}') AS ws, regexp_extract_all(coalesce(hypothesis, ''), '{_WORD}') AS hs FROM ap_pairs)"
_OVER = "CASE WHEN {0} > 0 THEN {0} ELSE greatest({1}, 1) END"
_OPS = f"SELECT *, n - c - (e - m + c) AS s, e - m + c AS d, e - n + c AS i FROM (SELECT *, levenshtein(a, b) AS e, length(a) AS n, length(b) AS m, {_MATCHES} AS c FROM ap_pairs)"


def _rates(keys: str, where: str = "", group: str | None = None) -> str:
    """The rates of corpus_rates by keys."""
    return f"SELECT {keys}, count(*) AS n, round(sum(e) / {_OVER.format('sum(n)', 'sum(m)')}, 6) AS cer, round(sum(we) / {_OVER.format('sum(wn)', 'sum(wm)')}, 6) AS wer, round(avg(coalesce(e / nullif(e + c, 0), 0.0)), 6) AS norm_cer FROM (SELECT *, levenshtein(a, b) AS e, length(a) AS n, length(b) AS m, {_MATCHES} AS c, levenshtein(wa, wb) AS we, length(wa) AS wn, length(wb) AS wm FROM ({_IN_WORDS})) {where} GROUP BY {group or keys}"


pairs("f12_cer", lambda s, d: text_pairs(s, d).select("doc_id", "pos", F.round(text.cer(F.col("reference"), F.col("hypothesis")), 6).alias("cer")), "SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(levenshtein(a, b) / CASE WHEN length(a) > 0 THEN length(a) ELSE greatest(length(b), 1) END, 6) AS cer FROM ap_pairs")
pairs("f12_edit_ops", lambda s, d: text_pairs(s, d).withColumn("o", text.text_edit_ops(F.col("reference"), F.col("hypothesis"))).select("doc_id", "pos", "o.*"), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(s AS INTEGER) AS s, CAST(d AS INTEGER) AS d, CAST(i AS INTEGER) AS i, CAST(c AS INTEGER) AS c FROM ({_OPS})")
pairs("f12_wer", lambda s, d: text_pairs(s, d).select("doc_id", "pos", F.round(text.wer(F.col("reference"), F.col("hypothesis")), 6).alias("wer")), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(levenshtein(wa, wb) / {_OVER.format('length(wa)', 'length(wb)')}, 6) AS wer FROM ({_IN_WORDS})")


def _turned_values(spark: SparkSession, sf: str) -> DataFrame:
    """Field values against themselves with two turns: the first letter last, the next two swapped. So paths matter."""
    v = F.coalesce("field_value", F.lit(""))
    turned = F.concat(F.substring(v, 3, 1), F.substring(v, 2, 1), F.substring(v, F.lit(4), F.char_length(v)), F.substring(v, 1, 1))
    return view(spark, sf, "ap_fields").select("id", v.alias("reference"), turned.alias("hypothesis"))


add("f12_normalized_cer", lambda s, d: _turned_values(s, d).select("id", F.round(text.normalized_cer(F.col("reference"), F.col("hypothesis")), 6).alias("norm_cer")),
    f"SELECT id, round(coalesce(levenshtein(a, b) / nullif(levenshtein(a, b) + {_MATCHES}, 0), 0.0), 6) AS norm_cer FROM (SELECT id, v AS a, substr(v, 3, 1) || substr(v, 2, 1) || substr(v, 4) || substr(v, 1, 1) AS b FROM (SELECT id, coalesce(field_value, '') AS v FROM ap_fields))", "ap_fields")
_N = r"nullif(replace(trim(regexp_replace(regexp_replace(lower(trim({0})), '(?i)(rs\.?|pkr|inr|usd|\$|€|£|/-)', '', 'g'), '\s+', ' ', 'g')), ',', ''), '')"
_NUMBER = lambda c: rf"CASE WHEN regexp_matches({c}, '^[+-]?(\d+\.?\d*|\.\d+)$') THEN TRY_CAST({c} AS DECIMAL(38,6)) END"
_BUCKETS = f"""SELECT doc_id, pos, doc_id || '_' || pos AS sample, field_name, CASE WHEN reference IS NULL AND hypothesis IS NULL THEN 'both_null' WHEN reference IS NULL THEN 'hallucination' WHEN hypothesis IS NULL THEN 'miss' WHEN t IS NOT DISTINCT FROM p THEN 'exact'
  WHEN field_name = 'total_amount' AND abs({_NUMBER('p')} - {_NUMBER('t')}) <= 0.02 THEN 'numeric_ok' WHEN levenshtein({_ONE_BYTE('p')}, {_ONE_BYTE('t')}) <= 2 THEN 'fuzzy' ELSE 'wrong' END AS bucket FROM (SELECT *, {_N.format('hypothesis')} AS p, {_N.format('reference')} AS t FROM ap_pairs)"""
pairs("f13_match_class", lambda s, d: text_pairs(s, d).select("doc_id", "pos", "field_name", text.match_class(F.col("hypothesis"), F.col("reference"), F.col("field_name")).alias("bucket")), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, field_name, bucket FROM ({_BUCKETS})")


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    p = text_pairs(spark, sf).select(F.concat_ws("_", "doc_id", "pos").alias("sample"), F.col("field_name").alias("field"), "hypothesis", "reference")
    return Q.align(p.where("hypothesis is not null").select("sample", "field", F.col("hypothesis").alias("value")), p.select("sample", "field", F.col("reference").alias("value")))


_SAFE = lambda num, den: f"coalesce(({num}) / nullif({den}, 0), 0.0)"
_PRF = f"""SELECT field, exact, numeric_ok, fuzzy, wrong, miss, hallucination, both_null, round(p, 3) AS precision, round(r, 3) AS recall, round({_SAFE('2 * p * r', 'p + r')}, 3) AS f1 FROM (SELECT *, {_SAFE('tp', 'tp + wrong + hallucination')} AS p, {_SAFE('tp', 'tp + miss + wrong')} AS r FROM (SELECT *, exact + numeric_ok + fuzzy AS tp FROM
  (SELECT field_name AS field, {', '.join(f"count(*) FILTER (bucket = '{k}') AS {k}" for k in ('exact', 'numeric_ok', 'fuzzy', 'wrong', 'miss', 'hallucination', 'both_null'))} FROM ({_BUCKETS}) GROUP BY 1)))"""
pairs("j7_align", _aligned, "SELECT doc_id || '_' || pos AS sample, field_name AS field, reference AS truth, hypothesis AS pred FROM ap_pairs")
pairs("q5_field_prf", lambda s, d: Q.field_prf(_aligned(s, d)), _PRF)
pairs("q6_field_verdicts", lambda s, d: Q.field_verdicts(Q.field_prf(_aligned(s, d))), f"SELECT field, f1, CASE WHEN f1 >= 0.8 THEN 'strong' WHEN f1 >= 0.5 THEN 'mid' ELSE 'weak' END AS verdict, CASE WHEN greatest(miss, wrong, hallucination) = 0 THEN NULL WHEN miss = greatest(miss, wrong, hallucination) THEN 'miss' WHEN wrong = greatest(miss, wrong, hallucination) THEN 'wrong' ELSE 'hallucination' END AS dominant_failure FROM ({_PRF})")
_CERS = "SELECT {0}, count(*) AS n, round(sum(levenshtein(a, b)) / CASE WHEN sum(length(a)) > 0 THEN sum(length(a)) ELSE greatest(sum(length(b)), 1) END, 6) AS cer FROM ap_pairs {1} GROUP BY {0}"
pairs("q1_corpus_cer", lambda s, d: Q.corpus_cer(text_pairs(s, d), "tier"), _CERS.format("tier", ""))
pairs("q1_corpus_rates", lambda s, d: Q.corpus_rates(text_pairs(s, d), "tier"), _rates("tier"))
pairs("q2_error_rates", lambda s, d: Q.error_rates(text_pairs(s, d)), _rates("tier, field_name", "", "GROUPING SETS ((tier, field_name), (tier))"))
QUERIES["q2_error_rates_whole"], SQL["q2_error_rates_whole"] = QUERIES["q2_error_rates"], SQL["q2_error_rates"]
_TIER_CER = f"SELECT max(cer) FILTER (tier = 'local') AS cer_a, max(cer) FILTER (tier = 'vlm') AS cer_b FROM ({_CERS.format('tier', '')})"
pairs("q2_tier_verdict", lambda s, d: Q.tier_verdict(text_pairs(s, d)), f"SELECT cer_a, cer_b, round((cer_a - cer_b) * 100, 4) AS points, CASE WHEN round((cer_a - cer_b) * 100, 4) > 2 THEN 'second is better' WHEN round((cer_a - cer_b) * 100, 4) < -2 THEN 'second is worse' ELSE 'similar' END AS verdict FROM ({_TIER_CER})")
pairs("q3_field_error_rates", lambda s, d: Q.field_error_rates(text_pairs(s, d)), f"SELECT *, CASE WHEN cer < 0.02 THEN 'EXCELLENT' WHEN cer < 0.1 THEN 'AVERAGE' ELSE 'POOR' END AS band FROM ({_rates('field_name', 'WHERE reference IS NOT NULL')})")
QUERIES["q3_field_error_rates_whole"], SQL["q3_field_error_rates_whole"] = QUERIES["q3_field_error_rates"], SQL["q3_field_error_rates"]
pairs("q4_tier_advantage", lambda s, d: Q.tier_advantage(text_pairs(s, d)), f"SELECT field_name, a.cer AS cer_a, b.cer AS cer_b, round((a.cer - b.cer) * 100, 2) AS points FROM ({_CERS.format('tier, field_name', '')}) a JOIN ({_CERS.format('tier, field_name', '')}) b USING (field_name) WHERE a.tier = 'local' AND b.tier = 'vlm'")
_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '(\w+)', 1)"
_F1 = f"SELECT *, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE coalesce(2.0 * list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda z: z = t)), len(list_filter(y, lambda z: z = t))))), 0) / (len(x) + len(y)) END AS f1 FROM (SELECT *, {_TOK.format('hypothesis')} AS x, {_TOK.format('reference')} AS y FROM ap_pairs)"
pairs("f15_token_f1", lambda s, d: text_pairs(s, d).select("doc_id", "pos", F.round(text.token_f1(F.col("hypothesis"), F.col("reference")), 6).alias("f1")), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM ({_F1})")
pairs("q7_exact_and_f1", lambda s, d: Q.exact_and_f1(_aligned(s, d)), rf"SELECT field_name AS field, count(*) AS n, round(avg(CAST(trim(regexp_replace(lower(coalesce(hypothesis, '')), '\s+', ' ', 'g')) = trim(regexp_replace(lower(reference), '\s+', ' ', 'g')) AS INTEGER)), 4) AS exact, round(CAST(avg(f1) AS DOUBLE), 4) AS token_f1 FROM ({_F1}) WHERE coalesce(reference, '') <> '' GROUP BY 1")
_LAT = "SELECT *, row_number() OVER (PARTITION BY status ORDER BY file_size) - 1 AS r, count(*) OVER (PARTITION BY status) AS m FROM ap_documents"
add("q8_latency_profile", lambda s, d: Q.latency_profile(view(s, d, "ap_documents"), "status", "file_size"), "SELECT status, count(*) AS n, min(file_size) AS min, " + ", ".join(f"min(file_size) FILTER (r = round_even({p} * (m - 1), 0)) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99)) + f", max(file_size) AS max, round(avg(file_size), 4) AS mean FROM ({_LAT}) GROUP BY status", "ap_documents")


def _items_check(spark: SparkSession, sf: str) -> DataFrame:
    items = view(spark, sf, "ap_line_items").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "description"))), lambda x: x["description"]).alias("truth"))
    keep = F.when(F.size("truth") % 2 == 0, F.transform("truth", lambda x: F.concat(x, F.lit("!")))).otherwise(F.slice("truth", 1, F.size("truth") - 1))
    return Q.line_item_match(items.select(F.col("document_id").alias("id"), "truth", keep.alias("pred")))


add("q10_line_item_match", _items_check, "SELECT document_id AS id, CASE WHEN n % 2 = 0 THEN 'match' ELSE 'under' END AS count_match, CAST(CASE WHEN n % 2 = 0 THEN n ELSE n - 1 END AS INTEGER) AS matched, CAST(CASE WHEN n % 2 = 0 THEN n ELSE n - 1 END AS INTEGER) AS compared FROM (SELECT document_id, count(*) AS n FROM ap_line_items GROUP BY 1)", "ap_line_items")
add("q11_field_coverage", lambda s, d: Q.field_coverage(view(s, d, "ap_fields").select(F.col("field_name").alias("field"), F.col("field_value").alias("value"))), "SELECT field_name AS field, count(*) AS n, count(*) FILTER (coalesce(field_value, '') <> '') AS present FROM ap_fields GROUP BY 1", "ap_fields")
pairs("q12_worst_pairs", lambda s, d: Q.worst_pairs(text_pairs(s, d), 20, "doc_id", "pos").select("doc_id", "pos", "cer", "ops.*"), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(e / {_OVER.format('n', 'm')}, 6) AS cer, CAST(s AS INTEGER) AS s, CAST(d AS INTEGER) AS d, CAST(i AS INTEGER) AS i, CAST(c AS INTEGER) AS c FROM ({_OPS}) ORDER BY 3 DESC, 1, 2 LIMIT 20")
QUERIES["q12_worst_pairs_whole"], SQL["q12_worst_pairs_whole"] = QUERIES["q12_worst_pairs"], SQL["q12_worst_pairs"]
pairs("q12_failure_examples", lambda s, d: Q.failure_examples(_aligned(s, d)).select("sample", "field", "bucket", "rank"), f"SELECT sample, field_name AS field, bucket, CAST(row_number() OVER (PARTITION BY field_name ORDER BY sample) AS INTEGER) AS rank FROM ({_BUCKETS}) WHERE bucket IN ('wrong', 'miss', 'hallucination') QUALIFY rank <= 3")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of fields as a score, whether they were right as a label."""
    return view(spark, sf, "ap_fields").where("confidence is not null").select("id", F.col("confidence").alias("p"), F.when(F.col("status") == "invalid", 0).otherwise(F.when(F.col("k") % 5 == 0, 0).otherwise(1)).alias("label"), F.col("field_name").alias("operator"))


_SCORED = "SELECT id, confidence AS p, CASE WHEN status = 'invalid' OR k % 5 = 0 THEN 0 ELSE 1 END AS label, field_name AS operator FROM ap_fields WHERE confidence IS NOT NULL"
_EDGE = " + ".join(f"CASE WHEN p >= {i / 10} THEN 1 ELSE 0 END" for i in range(1, 10))
add("q13_ece", lambda s, d: Q.ece(_scored(s, d)), f"SELECT bin, n, round(mean_p, 8) AS mean_p, round(share, 8) AS share, round(n / sum(n) OVER () * abs(mean_p - share), 8) AS ece_part FROM (SELECT CAST({_EDGE} AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS share FROM ({_SCORED}) GROUP BY 1)", "ap_fields")
_CUM = f"SELECT p, n, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER () AS tp, sum(n) OVER () AS tn FROM (SELECT p, count(*) AS n, sum(label) AS pos FROM ({_SCORED}) GROUP BY p) WINDOW w AS (ORDER BY p DESC)"
add("q14_best_threshold", lambda s, d: Q.best_threshold(_scored(s, d)), f"SELECT p AS threshold, f1 FROM (SELECT p, round(2 * cp / (cn + tp), 10) AS f1 FROM ({_CUM})) ORDER BY f1 DESC, p LIMIT 1", "ap_fields")
add("q15_recall_by_operator", lambda s, d: Q.recall_by_operator(_scored(s, d), 0.7), f"SELECT operator, count(*) AS n, round(avg(CAST(p < 0.7 AS INTEGER)), 6) AS recall FROM ({_SCORED}) WHERE label = 0 GROUP BY 1", "ap_fields")
add("q16_ranking_metrics", lambda s, d: Q.ranking_metrics(_scored(s, d)), f"SELECT round(sum((n - pos) * (cp - pos) + (n - pos) * pos / 2) / (any_value(tp) * (any_value(tn) - any_value(tp))), 8) AS auroc, round(sum(pos * cp / cn) / any_value(tp), 8) AS auprc FROM ({_CUM})", "ap_fields")
add("q17_threshold_prf", lambda s, d: Q.threshold_prf(_scored(s, d), 0.7), f"SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM (SELECT count(*) FILTER (p < 0.7 AND label = 0) AS tp, count(*) FILTER (p < 0.7 AND label = 1) AS fp, count(*) FILTER (p >= 0.7 AND label = 0) AS fn FROM ({_SCORED}))", "ap_fields")
_DOCCONF = f"""SELECT document_id, round(comp, 4) AS completeness, filled = 0 AS is_empty, round(CASE WHEN fallback_tier = 'vlm' THEN 0.8 * comp + 0.2 WHEN audit_reason IS NULL THEN greatest(0.3 * comp + 0.7 * coalesce(confidence_score, 0), 0.86) ELSE 0.6 * comp + 0.4 * coalesce(confidence_score, 0) END, 4) AS confidence, audit_reason, {_OK} AS audit_ok, fallback_tier
  FROM (SELECT *, filled / 6 AS comp FROM (SELECT document_id, {' + '.join(f"CASE WHEN trim(coalesce({f}, '')) <> '' THEN 1 ELSE 0 END" for f in ('invoice_number', 'date', 'vendor_name', 'subtotal', 'tax', 'total_amount'))} AS filled FROM ({_VALUES}))) c JOIN ({_AUDIT}) a USING (document_id) JOIN ap_documents d ON d.id = document_id"""
add("f16_document_confidence", _ap(R.document_confidence), f"SELECT * EXCLUDE (fallback_tier) FROM ({_DOCCONF})", *_ALL)
add("f17_field_confidence", _ap(R.field_confidence), f"""SELECT f.id, f.document_id, field_name, round(CASE WHEN trim(coalesce(field_value, '')) = '' THEN 0.0 WHEN NOT {_OK} AND field_name IN ('subtotal', 'tax', 'total_amount') THEN least(base, 0.55) ELSE base END, 3) AS confidence
  FROM ap_fields f JOIN ({_AUDIT}) a USING (document_id) JOIN (SELECT id AS did, CASE WHEN fallback_tier = 'vlm' THEN least(0.95, greatest(b, 0.9)) ELSE b END AS base FROM (SELECT id, fallback_tier, greatest(0.0, least(0.99, coalesce(confidence_score, 0.8))) AS b FROM ap_documents)) d ON did = f.document_id""", *_ALL)
add("f18_gate", lambda s, d: R.gate(R.document_confidence(sales_ledger(s, d)), view(s, d, "ap_documents").select(F.col("id").alias("document_id"), "fallback_tier", F.col("confidence_score").alias("ocr_confidence")), view(s, d, "ap_documents").select(F.col("id").alias("document_id"), (F.col("k") % 5).alias("attempts")), view(s, d, "ap_documents").select(F.col("id").alias("document_id"), (F.col("k") % 6 != 1).alias("ok"))), f"""SELECT document_id, gate_reason, CASE WHEN gate_reason IS NULL THEN 'valid' WHEN k % 5 >= 3 THEN 'hitl' ELSE 'retry' END AS route, CASE WHEN gate_reason IS NULL THEN 'verified' WHEN k % 5 >= 3 THEN 'review_pending' ELSE 'processing' END AS final_status
  FROM (SELECT document_id, CASE WHEN is_empty THEN 'no_data' WHEN NOT audit_ok THEN audit_reason WHEN coalesce(fallback_tier, 'local') <> 'vlm' AND confidence_score < 0.85 THEN 'low_confidence' WHEN coalesce(fallback_tier, 'local') <> 'vlm' AND audit_reason IS NOT DISTINCT FROM 'partial_data' THEN 'partial_data' WHEN coalesce(fallback_tier, 'local') <> 'vlm' AND k % 6 = 1 THEN 'low_plausibility' END AS gate_reason FROM (SELECT c.*, k, confidence_score FROM ({_DOCCONF}) c JOIN ap_documents x ON x.id = c.document_id)) g JOIN (SELECT id, k FROM ap_documents) x ON x.id = document_id""", *_ALL)


def _status_log(spark: SparkSession, sf: str) -> DataFrame:
    states = ("received", "preprocessed", "locally_parsed", "vlm_reconciled", "verified", "flagged", "failed")
    status = F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % 7 + 1).cast("int"))
    return view(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), status.alias("status"))


_PAIRS = "('received', 'preprocessed'), ('received', 'failed'), ('preprocessed', 'locally_parsed'), ('preprocessed', 'vlm_reconciled'), ('preprocessed', 'failed'), ('locally_parsed', 'verified'), ('locally_parsed', 'vlm_reconciled'), ('locally_parsed', 'flagged'), ('locally_parsed', 'failed'), ('vlm_reconciled', 'verified'), ('vlm_reconciled', 'flagged'), ('vlm_reconciled', 'failed')"
add("f19_invalid_transitions", lambda s, d: R.invalid_transitions(_status_log(s, d)).select("key", "seq", "before", "status"), f"SELECT key, seq, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY ts, seq) AS before FROM (SELECT user_id AS key, ts, event_id AS seq, ['received', 'preprocessed', 'locally_parsed', 'vlm_reconciled', 'verified', 'flagged', 'failed'][event_id % 7 + 1] AS status FROM events)) WHERE before IS NOT NULL AND (before, status) NOT IN (VALUES {_PAIRS})")

# Layout
_LABELLED = "SELECT *, CASE WHEN pos % 2 = 0 THEN CASE text WHEN 'Vendor:' THEN 'vendor_name' WHEN 'Invoice No:' THEN 'invoice_number' WHEN 'Date:' THEN 'date' WHEN 'Subtotal' THEN 'subtotal' WHEN 'Tax' THEN 'tax' ELSE 'total_amount' END END AS label FROM ap_blocks"
add("f21_classify_blocks", lambda s, d: L.classify_blocks(view(s, d, "ap_blocks")).select("document_id", "pos", "label", "amount"), f"SELECT document_id, pos, label, CASE WHEN pos IN (9, 11, 13) THEN replace(text, '$', '') END AS amount FROM ({_LABELLED})", "ap_blocks")
add("w4_reading_order", lambda s, d: L.reading_order(view(s, d, "ap_blocks")), "SELECT document_id, 1 AS page, string_agg(line, chr(10) ORDER BY y1) AS text FROM (SELECT document_id, y1, string_agg(text, ' ' ORDER BY x1) AS line FROM ap_blocks GROUP BY 1, 2) GROUP BY 1", "ap_blocks")
#: The layout rule in the other engine's SQL, over {0} (blocks with labels and amounts): all pairs of a page, each label's best value, then labels in order.
_LAYOUT = """SELECT document_id, unnest(got).f AS field_name, unnest(got).x AS value FROM (SELECT document_id, list_reduce(list({{'l': l, 'v': v, 'f': f, 'x': x}} ORDER BY l), lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: q.f = p.f OR q.v = p.v)) > 0 THEN acc ELSE list_append(acc, p) END, []::STRUCT(l INTEGER, v INTEGER, f VARCHAR, x VARCHAR)[]) AS got FROM (
  SELECT document_id, l, v, f, x FROM (SELECT *, row_number() OVER (PARTITION BY document_id, l ORDER BY way, cost, v) AS r FROM (SELECT document_id, l, v, f, x, CASE WHEN beside THEN 0 ELSE 1 END AS way, CASE WHEN beside THEN gap ELSE drop + 0.25 * dx END AS cost FROM (
    SELECT l.document_id, l.pos AS l, v.pos AS v, l.label AS f, coalesce(v.amount, trim(v.text)) AS x, l.label IN ('total_amount', 'subtotal', 'tax') AS money, greatest(l.y2 - l.y1, 1) AS h, greatest(l.x2 - l.x1, 1) AS w, v.x1 - l.x2 AS gap, v.y1 - l.y2 AS drop, abs(v.x1 + v.x2 - l.x1 - l.x2) / 2 AS dx,
      abs(v.y1 + v.y2 - l.y1 - l.y2) / 2 <= 0.9 * h AND gap >= -0.25 * w AS beside, CASE WHEN money THEN v.amount IS NOT NULL ELSE v.label IS NULL AND trim(v.text) <> '' END AS fits
    FROM {0} l JOIN {0} v ON v.document_id = l.document_id AND v.page = l.page AND v.pos <> l.pos WHERE l.label IS NOT NULL)
    WHERE fits AND (beside OR (drop >= -0.225 * h AND dx <= CASE WHEN money THEN greatest(3 * w, 6 * h) ELSE greatest(2 * w, 4 * h) END)))) WHERE r = 1) GROUP BY document_id)"""
_LABELLED_AMOUNTS = f"SELECT *, CASE WHEN pos IN (9, 11, 13) THEN replace(text, '$', '') END AS amount FROM ({_LABELLED})"
add("j5_pair_labels", lambda s, d: L.pair_labels(view(s, d, "ap_blocks")), _LAYOUT.format(f"({_LABELLED_AMOUNTS})"), "ap_blocks")


def _uneven_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of lines that aren't level, some values below their labels instead of beside them."""
    below, shift = (F.col("pos") % 2 == 1) & ((F.col("k") + F.col("pos")) % 6 == 1), (7 * F.col("pos") + F.col("k")) % 5
    moved = {"x1": F.when(below, F.lit(12.0)).otherwise(F.col("x1") + F.col("k") % 11), "x2": F.when(below, F.lit(112.0)).otherwise(F.col("x2") + F.col("k") % 11)}
    y = {"y1": F.when(below, F.col("y1") + 12.0).otherwise(F.col("y1") + shift), "y2": F.when(below, F.col("y1") + 19.0).otherwise(F.col("y2") + shift)}
    return view(spark, sf, "ap_blocks").withColumns({**moved, **y})


_UNEVEN = f"""(SELECT document_id, page, pos, text, label, amount, CASE WHEN u THEN 12.0 ELSE x1 + k % 11 END AS x1, CASE WHEN u THEN 112.0 ELSE x2 + k % 11 END AS x2, CASE WHEN u THEN y1 + 12 ELSE y1 + (7 * pos + k) % 5 END AS y1, CASE WHEN u THEN y1 + 19 ELSE y2 + (7 * pos + k) % 5 END AS y2
  FROM (SELECT *, pos % 2 = 1 AND (k + pos) % 6 = 1 AS u FROM ({_LABELLED_AMOUNTS})))"""
add("j5_pair_labels_uneven", lambda s, d: L.pair_labels(_uneven_blocks(s, d)), _LAYOUT.format(_UNEVEN), "ap_blocks")
#: Lines of {0} by the first block of each, as a fold over a page's blocks in order.
_FOLD = """SELECT document_id, page, array_to_string(list_transform(ls, lambda l: array_to_string(list_transform(list_sort(l), lambda w: w.text), ' ')), chr(10)) AS text FROM (SELECT document_id, page, list_reduce(bs, lambda acc, b: CASE WHEN acc.a IS NOT NULL AND abs(b.cy - acc.a) <= greatest(8, 0.6 * h) THEN {{'a': acc.a, 'ls': list_append(acc.ls[:len(acc.ls) - 1], list_append(acc.ls[len(acc.ls)], {{'x1': b.x1, 'pos': b.pos, 'text': b.text}}))}}
    ELSE {{'a': b.cy, 'ls': list_append(acc.ls, [{{'x1': b.x1, 'pos': b.pos, 'text': b.text}}])}} END, {{'a': NULL::DOUBLE, 'ls': []::STRUCT(x1 DOUBLE, pos INTEGER, text VARCHAR)[][]}}).ls AS ls
  FROM (SELECT document_id, page, avg(greatest(y2 - y1, 1)) AS h, list({{'cy': CAST((y1 + y2) / 2 AS DOUBLE), 'x1': CAST(x1 AS DOUBLE), 'pos': pos, 'text': text}} ORDER BY (y1 + y2) / 2, x1, pos) AS bs FROM {0} GROUP BY ALL))"""
add("w4_reading_order_uneven", lambda s, d: L.reading_order(_uneven_blocks(s, d)), _FOLD.format(_UNEVEN), "ap_blocks")
_MONEY = "SELECT document_id, v, min(pos) AS pos FROM (SELECT document_id, pos, CAST(replace(text, '$', '') AS DECIMAL(38,6)) AS v FROM ap_blocks WHERE pos IN (9, 11, 13)) WHERE v > 0 GROUP BY 1, 2"
add("j6_triangulate", lambda s, d: L.triangulate(L.classify_blocks(view(s, d, "ap_blocks")).where("amount is not null").select("document_id", "pos", F.col("amount").alias("value"))).select("document_id", *[F.col(c).cast("double").alias(c) for c in ("total", "subtotal", "tax")]), f"""SELECT document_id, CAST(total AS DOUBLE) AS total, CAST(subtotal AS DOUBLE) AS subtotal, CAST(tax AS DOUBLE) AS tax FROM (SELECT t.document_id, t.v AS total, s.v AS subtotal, x.v AS tax, row_number() OVER (PARTITION BY t.document_id ORDER BY t.v DESC, s.v DESC, x.pos) AS r
  FROM ({_MONEY}) t JOIN ({_MONEY}) s ON s.document_id = t.document_id AND s.v < t.v JOIN ({_MONEY}) x ON x.document_id = t.document_id AND x.v < t.v AND abs(x.v - (t.v - s.v)) <= 0.02 WHERE t.document_id IN (SELECT document_id FROM ({_MONEY}) GROUP BY 1 HAVING count(*) >= 3)) WHERE r = 1""", "ap_blocks")


def _raw_ocr(spark: SparkSession, sf: str) -> DataFrame:
    b = view(spark, sf, "ap_blocks")
    point = lambda x, y: F.array(F.col(x), F.col(y))
    poly = F.when(F.col("pos") % 3 == 0, F.array(F.array("x1", "y1", "x2", "y2"))).otherwise(F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")))
    one = F.struct("pos", F.when(F.col("pos") == 5, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("pos") != 7, F.col("score")).alias("score"), poly.alias("poly"))
    g = b.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(one)).alias("b"))
    return g.select("document_id", "page", F.col("b.text").alias("texts"), F.col("b.score").alias("scores"), F.col("b.poly").alias("polygons"))


add("f20_flatten_ocr", lambda s, d: L.flatten_ocr(_raw_ocr(s, d)).drop("pos"), "SELECT document_id, page, text, CASE WHEN pos = 7 THEN 0.0 ELSE score END AS score, x1, y1, x2, y2 FROM ap_blocks WHERE pos <> 5", "ap_blocks")

# Forecasts and anomalies
_SERIES = f"SELECT month, total_spend AS value, row_number() OVER (ORDER BY month) - 1 AS x FROM ({_MONTH})"
_series = lambda s, d: A.spend_by_month(sales_ledger(s, d)).select("month", F.col("total_spend").alias("value"))
add("m5_forecast_linear", lambda s, d: M.forecast_linear(_series(s, d)), f"SELECT strftime(CAST(m || '-01' AS DATE) + k * INTERVAL 1 MONTH, '%Y-%m') AS month, round(greatest(a + b * (n + k), 0), 2) AS forecast FROM (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(x) AS n, max(month) AS m FROM ({_SERIES})), (VALUES (1), (2), (3)) v(k)", "ap_documents", "ap_fields")
add("m6_forecast_ar", lambda s, d: M.forecast_ar(_series(s, d)))
_VSERIES = "SELECT vendor_name, strftime(uploaded_at, '%Y-%m') AS month, CAST(sum(CAST(coalesce({0}, 0) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM ({1}) v JOIN ap_documents d ON d.id = v.document_id WHERE coalesce(vendor_name, '') <> '' GROUP BY 1, 2".format(_num("total_amount"), _VALUES)


def _vendor_series(spark: SparkSession, sf: str) -> DataFrame:
    ap = sales_ledger(spark, sf)
    v = A._vendor_amounts(ap).join(ap.documents.select(F.col("id").alias("document_id"), "uploaded_at"), "document_id").where("vendor_name <> ''")
    return v.groupBy("vendor_name", F.date_format("uploaded_at", "yyyy-MM").alias("month")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("value"))


add("m5_forecast_by_vendor", lambda s, d: M.forecast_linear(_vendor_series(s, d), 1, "vendor_name"), f"SELECT vendor_name, strftime(CAST(m || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS month, round(greatest(CASE WHEN n = 0 THEN last ELSE a + b * (n + 1) END, 0), 2) AS forecast FROM (SELECT vendor_name, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(x) AS n, max(month) AS m, max_by(value, month) AS last FROM (SELECT *, row_number() OVER (PARTITION BY vendor_name ORDER BY month) - 1 AS x FROM ({_VSERIES})) GROUP BY 1)", "ap_documents", "ap_fields")
_Z = f"SELECT document_id, n_corrections, CASE WHEN sa > 0 THEN abs((amount - ma) / sa) ELSE 0 END AS za, CASE WHEN sc > 0 THEN abs((conf - mc) / sc) ELSE 0 END AS zc FROM (SELECT *, avg(amount) OVER () AS ma, stddev_pop(amount) OVER () AS sa, avg(conf) OVER () AS mc, stddev_pop(conf) OVER () AS sc FROM (SELECT document_id, coalesce(amount, 0) AS amount, coalesce(avg_confidence, 0) AS conf, n_corrections FROM ({_STATS})))"
add("m1_anomalies", lambda s, d: M.anomalies(A.document_stats(sales_ledger(s, d))).select("document_id", F.array_join("reasons", ",").alias("reasons"), "score"), f"SELECT document_id, concat_ws(',', CASE WHEN za > 2 THEN 'unusual_amount' END, CASE WHEN zc > 2 THEN 'unusual_confidence' END, CASE WHEN n_corrections > 3 THEN 'many_corrections' END) AS reasons, round((CAST(za > 2 AS INTEGER) + CAST(zc > 2 AS INTEGER) + CAST(n_corrections > 3 AS INTEGER)) / 3, 4) AS score FROM ({_Z}) WHERE za > 2 OR zc > 2 OR n_corrections > 3", *_ALL)
_DASH = f"""SELECT documents, avg_trust, avg_confidence, compliance_rate, needs_review, escalate, "reject", compliance_exceptions, total_spend, high_risk_vendors, documents_by_status, validation_failures, anomalies, correction_rate, avg_corrections, with_corrections, without_corrections FROM
  (SELECT count(*) AS documents, round(avg(trust_score), 1) AS avg_trust, round(coalesce(avg(c), 0), 3) AS avg_confidence, round(count(*) FILTER (n_invalid = 0) / count(*) * 100, 2) AS compliance_rate, count(*) FILTER (priority <> 'Auto-Approve Candidate') AS needs_review, count(*) FILTER (priority = 'Escalate') AS escalate, count(*) FILTER (priority = 'Reject / Incomplete') AS "reject", count(*) FILTER (n_invalid > 0) AS compliance_exceptions FROM trust),
  (SELECT CAST(sum(CAST(total_spend AS DECIMAL(28,2))) AS DOUBLE) AS total_spend FROM ({_SPEND})), (SELECT count(*) FILTER (risk_score >= 60) AS high_risk_vendors FROM ({_VENDOR_RISK})),
  (SELECT string_agg(status || '=' || n, ',' ORDER BY status) AS documents_by_status FROM (SELECT status, count(*) AS n FROM ap_documents GROUP BY 1)), (SELECT string_agg(field_name || '=' || n, ',' ORDER BY field_name) AS validation_failures FROM (SELECT field_name, count(*) AS n FROM ap_fields WHERE status = 'invalid' GROUP BY 1)),
  (SELECT count(*) AS anomalies FROM ({_Z}) WHERE za > 2 OR zc > 2 OR n_corrections > 3),
  (SELECT round(count(*) FILTER (n_corrections > 0) / count(*) * 100, 2) AS correction_rate, round(sum(n_corrections) / count(*), 2) AS avg_corrections, count(*) FILTER (n_corrections > 0) AS with_corrections, count(*) FILTER (n_corrections = 0) AS without_corrections FROM ({_STATS}))"""
SQL["a5_dashboard"] = _with_trust(_DASH)
add("m2_isolation_forest", lambda s, d: M.isolation_forest(A.document_stats(sales_ledger(s, d))))
_FORECAST = f"SELECT round(greatest(a + b * (n + 3), 0), 2) AS forecast FROM (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(x) AS n FROM ({_SERIES}))"
add("m8_insights", lambda s, d: M.insights(A.supplier_risk(A.supplier_metrics(sales_ledger(s, d))), _series(s, d), M.forecast_linear(_series(s, d)), M.anomalies(A.document_stats(sales_ledger(s, d)))), f"""
  SELECT insight FROM (SELECT unnest(list_filter([
      CASE WHEN high IS NOT NULL THEN 'High-risk suppliers detected: ' || high || '. Consider additional review.' END,
      CASE WHEN forecast > last * 1.2 THEN 'Spend is projected to increase significantly. Review budget allocations.' WHEN forecast < last * 0.8 THEN 'Spend is projected to decrease. Verify supplier activity.' END,
      CASE WHEN odd > 0 THEN odd || ' anomalous document(s) detected. Review flagged documents for potential issues.' END,
      CASE WHEN high IS NULL AND odd = 0 AND forecast BETWEEN last * 0.8 AND last * 1.2 THEN 'No significant concerns detected. All metrics within normal range.' END], lambda x: x IS NOT NULL)) AS insight
    FROM (SELECT string_agg(supplier_name, ', ' ORDER BY supplier_name) AS high FROM ({_RISK}) WHERE risk_score >= 60), (SELECT max_by(value, month) AS last FROM ({_SERIES})), ({_FORECAST}),
      (SELECT count(*) AS odd FROM ({_Z}) WHERE za > 2 OR zc > 2 OR n_corrections > 3))""", *_ALL)
add("m9_calibrate", _ap(M.calibrate))

# The verifier
TODAY = "1998-08-01"
_wide = lambda s, d: D.invoice_wide(sales_ledger(s, d))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return V.features(_wide(spark, sf), TODAY).select("document_id", *[F.round(f, 6).alias(f) for f in ("math_residual_relative", "math_residual_absolute", "log_total", "tax_to_subtotal_ratio", "n_line_items", "has_vendor_name", "vendor_name_length", "invoice_number_alnum_ratio", "date_within_5_years", "currency_marker_count_distinct")])


_FDEC = f"SELECT document_id, vendor_name, invoice_number, date, total_amount, CAST({_DEC['total_amount']} AS DOUBLE) AS t, CAST({_DEC['subtotal']} AS DOUBLE) AS s, CAST({_DEC['tax']} AS DOUBLE) AS x FROM ({_VALUES})"
add("m10_features", _features, f"""SELECT document_id, round(coalesce(round(abs(s + x - t), 6) / greatest(abs(t), 1), 0.0), 6) AS math_residual_relative, round(coalesce(abs(s + x - t), 0.0), 6) AS math_residual_absolute, round(CASE WHEN abs(t) > 1e-9 THEN log10(abs(t)) ELSE 0.0 END, 6) AS log_total, round(CASE WHEN abs(s) > 1e-9 AND x IS NOT NULL THEN x / s ELSE 0.0 END, 6) AS tax_to_subtotal_ratio, CAST(coalesce(n_items, 0) AS DOUBLE) AS n_line_items,
  CAST(coalesce(vendor_name, '') <> '' AS DOUBLE) AS has_vendor_name, CAST(length(coalesce(vendor_name, '')) AS DOUBLE) AS vendor_name_length, round(CASE WHEN coalesce(invoice_number, '') <> '' THEN length(regexp_replace(invoice_number, '[^A-Za-z0-9]', '', 'g')) / length(invoice_number) ELSE 0.0 END, 6) AS invoice_number_alnum_ratio, CAST(coalesce(abs(date_diff('day', CAST(date AS DATE), DATE '{TODAY}')) <= 1830, false) AS DOUBLE) AS date_within_5_years, CAST(contains(coalesce(total_amount, ''), '$') AS DOUBLE) AS currency_marker_count_distinct
  FROM ({_FDEC}) v LEFT JOIN ({_ITEMS}) i USING (document_id)""", "ap_fields", "ap_line_items")
add("m10_features_all", lambda s, d: V.features(_wide(s, d), TODAY).select("document_id", *[F.round(f, 6).alias(f) for f in V.FEATURES]))
add("m11_corrupt", lambda s, d: V.corrupt(_wide(s, d), 2))
add("m12_training_set", lambda s, d: _training_rows(s, d))


def _training_rows(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    """Clean documents, their corrupted copies, and corrected documents before and after."""
    ap = sales_ledger(spark, sf)
    fields = stored(view(spark, sf, "ap_fields"), "fields")
    ap = replace(ap, fields=fields.drop("k", "i"), corrections=spark.sql(VIEWS["ap_corrections"], ap_fields=fields))
    wide = stored(D.invoice_wide(ap), "wide")
    clean = stored(wide.join(D.clean_documents(ap).select("document_id"), "document_id", "left_semi"), "clean")
    return V.training_set(clean, *D.corrected_wide(ap, wide), k=k)


#: Per session and tables the folders of the labelled features and of the verifier that was trained on them.
_MADE: dict[tuple, str] = {}


def _once(spark: SparkSession, sf: str, what: str, make: Callable[[str], None]) -> str:
    """The folder that make wrote, by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _MADE:
        path = shared_folder(spark, what)
        make(path)
        _MADE[key] = path
    return _MADE[key]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with their features, as a table: the corruptions are worked out once."""
    columns = ["document_id", "label", "weight", "validation", "operator", *V.FEATURES]
    write = lambda path: V.features(_training_rows(spark, sf, k=4), TODAY).select(columns).write.parquet(path)
    return spark.read.parquet(_once(spark, sf, "labelled", write)).select(columns)


def _verifier(spark: SparkSession, sf: str) -> V.Verifier:
    """The verifier as it is loaded after training with the usual settings, and saving."""
    return V.load_verifier(spark, _once(spark, sf, "verifier", lambda path: V.save_verifier(V.train_verifier(_labelled(spark, sf)), spark, path)))


def _scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    return V.score(V.features(_wide(spark, sf), TODAY), _verifier(spark, sf)).select("document_id", F.round("p", 6).alias("p"), "ok", "reason", F.array_join("top_features", ",").alias("top_features"))


add("m14_verifier_scores", _scored_documents)


def _retried(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through audit, verifier, gate and up to three replies; the first reply of some is cut short."""
    docs = view(spark, sf, "ap_documents").select(F.col("id").alias("document_id"), "fallback_tier", F.col("confidence_score").alias("ocr_confidence"))
    wide, replies = _wide(spark, sf).join(docs, "document_id"), stored(view(spark, sf, "ap_replies"), "replies")
    cut = lambda n: F.when((F.col("k") + n) % 4 == 0, F.substring("reply", 1, 20)).otherwise(F.col("reply"))
    reply = lambda n: replies.select("document_id", cut(n).alias("reply"), F.lit(0.9).alias("confidence"))
    model = _verifier(spark, sf)
    return reconcile(wide, reply, lambda open_: V.score(V.features(open_.select("document_id", *V.FIELDS, "items"), TODAY), model).select("document_id", "ok")).drop("items")


add("f18_retry_loop", _retried)


def _verifier_report(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the verifier, and its recall of each corruption."""
    card = _verifier(spark, sf)
    rows = [*card.metrics.items(), ("threshold", card.threshold), *((f"recall of {k}", v) for k, v in sorted(card.recalls.items()))]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "metric string, value double")


add("m13_train_verifier", _verifier_report)
add("m4_supplier_risk_ml", lambda s, d: V.supplier_risk_ml(A.supplier_metrics(sales_ledger(s, d))))
add("f22_target_json", lambda s, d: V.target_json(_wide(s, d)).select("document_id", F.get_json_object("target", "$.vendor_name").alias("vendor_name"), F.get_json_object("target", "$.line_items[0].description").alias("first_item")), f"SELECT document_id, vendor_name, first_item FROM ({_VALUES}) v LEFT JOIN (SELECT document_id, min_by(description, id) AS first_item FROM ap_line_items GROUP BY 1) i USING (document_id)", "ap_fields", "ap_line_items")


# Streams
def _stream(spark: SparkSession, sf: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _documents_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(VIEWS["ap_documents"], orders=_stream(spark, sf, "orders"))


add("t1_stream_throughput", lambda s, d: ran(J.throughput(_documents_stream(s, d)), "update", ["day"]), "SELECT strftime(uploaded_at, '%Y-%m-%d') AS day, count(*) AS documents FROM ap_documents GROUP BY 1", "ap_documents")
add("t2_stream_confidence_drift", lambda s, d: ran(J.confidence_drift(J.with_confidence(_documents_stream(s, d), view(s, d, "ap_fields"))), "update", ["day"]), "SELECT strftime(uploaded_at, '%Y-%m-%d') AS day, CAST((2000 * sum(CAST(CAST(conf AS DECIMAL(10,6)) * 1000000 AS BIGINT)) + 1000000 * count(*)) // (2000000 * count(*)) AS BIGINT) / 1000.0E0 AS avg_confidence, count(*) AS documents FROM (SELECT uploaded_at, coalesce(confidence_score, m) AS conf FROM ap_documents LEFT JOIN (SELECT document_id, avg(confidence) AS m FROM ap_fields GROUP BY 1) f ON f.document_id = id) WHERE conf IS NOT NULL GROUP BY 1", "ap_documents", "ap_fields")


def _stream_transitions(spark: SparkSession, sf: str) -> DataFrame:
    states = ("received", "preprocessed", "locally_parsed", "vlm_reconciled", "verified", "flagged", "failed")
    status = F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % 7 + 1).cast("int"))
    log = _stream(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), status.alias("status"))
    return ran(J.invalid_transitions(log), "append")


add("t3_stream_invalid_transitions", _stream_transitions, SQL["f19_invalid_transitions"])
add("t3_stream_batch_progress", lambda s, d: ran(J.batch_progress(_documents_stream(s, d).where("batch_id is not null").select("batch_id", F.col("id").alias("document_id"), "status", F.col("k").alias("seq"))), "append"), f"SELECT batch_id, CASE WHEN failed > 0 THEN 'partial_failed' ELSE 'completed' END AS status FROM ({_BATCH}) WHERE uploaded + processing = 0", *_ALL)


def _recalibrated(spark: SparkSession, sf: str) -> J.Recalibration:
    """Thresholds after all corrections have come in a stream, four files at a time. Fits read stored fields."""
    path, ap = shared_folder(spark, "corrections"), sales_ledger(spark, sf)
    fields = stored(view(spark, sf, "ap_fields"), "fields")
    ap = replace(ap, fields=fields.drop("k", "i"), corrections=spark.sql(VIEWS["ap_corrections"], ap_fields=fields))
    ap.corrections.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(ap.corrections.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    loop = J.Recalibration(ap, path)
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(loop).start().awaitTermination()
    return loop


def _recalibrations(spark: SparkSession, sf: str) -> DataFrame:
    """How many corrections came, after how many tens of them thresholds were to be fitted, and after how many they were."""
    loop = _recalibrated(spark, sf)
    n = loop.corrections()
    return spark.createDataFrame([(n, n // 10, loop.published() // 10)], "corrections long, due long, published long")


add("t4_recalibrations", _recalibrations, "SELECT count(*) AS corrections, count(*) // 10 AS due, count(*) // 10 AS published FROM ap_corrections", "ap_corrections")


def _published_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The review queue by the thresholds that the stream published last."""
    loop = _recalibrated(spark, sf)
    return R.review_queue(loop.ledger, loop.thresholds.read().select("field_name", "threshold")).groupBy("field_name", "review", "reason").agg(F.count("*").alias("fields"))


add("t4_review_queue", _published_queue)
