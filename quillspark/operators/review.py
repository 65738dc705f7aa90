"""Validation, reconciliation, review queue, confidences, gate and routing, state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amt_float
from ..functions.audit import audit, magnitude_slip
from ..sources.ledger import FIELDS, REQUIRED, Ledger
from .documents import document_items, field_values

#: What a wrong field costs, and the allowed expected loss.
CRITICALITY = {"total_amount": 5.0, "invoice_number": 4.0, "date": 3.0, "vendor_name": 2.0}
BUDGET = 0.10


def criticality(field: Column) -> Column:
    return F.coalesce(*[F.when(field == k, v) for k, v in CRITICALITY.items()], F.lit(1.0))


def validate_fields(ap: Ledger) -> DataFrame:
    """Every field's status and message by the rules: required, then format; names without a rule are valid."""
    v, name = F.coalesce("field_value", F.lit("")), F.col("field_name")
    blank = F.trim(v) == ""
    message = (
        F.when(name.isin(*REQUIRED) & blank, F.concat(name, F.lit(" is required")))
        .when(blank, None)
        .when((name == "invoice_number") & ~v.rlike(r"^INV-\d{4}-\d{4}$"), "Invoice number must match INV-YYYY-NNNN")
        .when((name == "date") & F.try_to_date(F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), v), "yyyy-M-d").isNull(), "Date must be YYYY-MM-DD")
        .when(name.isin("total_amount", "subtotal", "tax") & amt_float(v).isNull(), F.concat(name, F.lit(" must be a number")))
    )
    return ap.fields.select("id", "document_id", "field_name", "field_value", "created_at", F.when(message.isNull(), "valid").otherwise("invalid").alias("status"), message.alias("error_message"))


def reconcile(ap: Ledger) -> DataFrame:
    """validate_fields, and the (first) total_amount of a document whose items don't add up to it made invalid."""
    fields = validate_fields(ap)
    first = fields.where("field_name = 'total_amount'").groupBy("document_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.min_by("field_value", F.struct("created_at", "id")).alias("value"))
    off = first.withColumn("amount", amt_float(F.col("value"))).join(document_items(ap), "document_id").where(F.abs(F.col("items_total").cast("double") - F.col("amount")) >= 0.01)
    note = off.select("id", F.format_string("Line items sum %.2f does not match total %.2f", F.col("items_total").cast("double"), F.col("amount")).alias("note"))
    out = fields.join(note, "id", "left")
    return out.select("id", "document_id", "field_name", F.when(F.col("note").isNotNull(), "invalid").otherwise(F.col("status")).alias("status"), F.coalesce("note", "error_message").alias("error_message"))


def review_queue(ap: Ledger, thresholds: DataFrame | None = None, budget: float = BUDGET, default: float = 0.5) -> DataFrame:
    """Every field with its risk and whether it is to be reviewed; the riskiest come first, those without confidence above all."""
    w = criticality(F.col("field_name"))
    floor = F.greatest(F.lit(0.0), F.least(F.lit(0.99), 1 - budget / w))
    df = ap.fields if thresholds is None else ap.fields.join(F.broadcast(thresholds), "field_name", "left")  # a row per field name
    learned = F.lit(default) if thresholds is None else F.coalesce("threshold", F.lit(default))
    conf = F.col("confidence")
    risk = F.when(conf.isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), 1 - conf) * w)
    shown = (F.col("status") == "invalid") | conf.isNull() | (conf < F.greatest(learned, floor))
    reason = F.when(F.col("status") == "invalid", "validation_failed").when(conf.isNull(), "missing_confidence").when(w > 1, "critical_field").otherwise("low_confidence")
    out = df.select("id", "document_id", "field_name", "status", "confidence", F.round(risk, 6).alias("risk"), shown.alias("review"), F.when(shown, reason).alias("reason"))
    return out


def ordered_queue(queue: DataFrame) -> DataFrame:
    return queue.where("review").orderBy(F.desc("risk"), "id")


def hitl_totals(queue: DataFrame) -> DataFrame:
    return queue.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if("review").alias("shown"), F.count_if(~F.col("review")).alias("skipped"), F.round(F.coalesce(F.sum(F.when(~F.col("review"), F.col("risk"))), F.lit(0.0)), 6).alias("residual"))


def audits(ap: Ledger) -> DataFrame:
    """Exact audit and magnitude slip of every document with fields."""
    wide = field_values(ap, "subtotal", "tax", "total_amount").join(document_items(ap), "document_id", "left")
    return magnitude_slip(audit(wide), "items_total")


def document_confidence(ap: Ledger) -> DataFrame:
    """Completeness and confidence: a triple that audits well counts for much; the second tier trusts completeness."""
    wide = audit(field_values(ap, *FIELDS)).join(ap.documents.select(F.col("id").alias("document_id"), "fallback_tier", "confidence_score"), "document_id")
    filled = sum((F.when(F.coalesce(F.trim(f), F.lit("")) != "", 1).otherwise(0) for f in FIELDS), F.lit(0))
    comp, ocr = filled / 6, F.coalesce("confidence_score", F.lit(0.0))
    whole = F.col("audit_reason").isNull()
    conf = F.when(F.col("fallback_tier") == "vlm", 0.8 * comp + 0.2).when(whole, F.greatest(0.3 * comp + 0.7 * ocr, F.lit(0.86))).otherwise(0.6 * comp + 0.4 * ocr)
    return wide.select("document_id", F.round(comp, 4).alias("completeness"), (filled == 0).alias("is_empty"), F.round(conf, 4).alias("confidence"), "audit_reason", "audit_ok")


def field_confidence(ap: Ledger) -> DataFrame:
    """Confidence of each field from the document's, the tier and the audit."""
    doc = audit(field_values(ap, "subtotal", "tax", "total_amount")).select("document_id", "audit_reason", "audit_ok")
    df = ap.fields.join(doc, "document_id", "left").join(ap.documents.select(F.col("id").alias("document_id"), "fallback_tier", "confidence_score"), "document_id")
    base = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.coalesce("confidence_score", F.lit(0.80))))
    base = F.when(F.col("fallback_tier") == "vlm", F.least(F.lit(0.95), F.greatest(base, F.lit(0.90)))).otherwise(base)
    failed = ~F.coalesce("audit_ok", F.lit(True)) & F.col("field_name").isin("subtotal", "tax", "total_amount")
    conf = F.when(F.coalesce(F.trim("field_value"), F.lit("")) == "", 0.0).when(failed, F.least(base, F.lit(0.55))).otherwise(base)
    return df.select("id", "document_id", "field_name", F.round(conf, 3).alias("confidence"))


#: Fixed value: replies that a document may get before it is a person's.
MOST_ATTEMPTS = 3


def gate(confidences: DataFrame, tiers: DataFrame, attempts: DataFrame | None = None, verifier: DataFrame | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Decision per document: reason by precedence, then valid, retry or hitl, and the final status.

    tiers: (document_id, fallback_tier, ocr_confidence); verifier: (document_id, ok), as its scores have it. An audit failure
    stops every tier. The first tier also stops for a low OCR confidence (an unknown one isn't low), partial data, and
    what the verifier finds implausible, in this order.
    """
    df = confidences.join(tiers, "document_id")
    df = df.withColumn("plausible", F.lit(True)) if verifier is None else df.join(verifier.select("document_id", F.col("ok").alias("plausible")), "document_id", "left")
    df = df.withColumn("attempts", F.lit(0)) if attempts is None else df.join(attempts, "document_id", "left").fillna({"attempts": 0})
    return decided(df, most).select("document_id", "gate_reason", "route", "final_status")


def decided(df: DataFrame, most: int) -> DataFrame:
    """df (is_empty, audit_reason, audit_ok, fallback_tier, ocr_confidence, attempts, plausible) with gate_reason, route and final_status."""
    first_tier = F.coalesce("fallback_tier", F.lit("local")) != "vlm"
    reason = (
        F.when(F.col("is_empty"), "no_data")
        .when(~F.col("audit_ok"), F.col("audit_reason"))
        .when(first_tier & (F.col("ocr_confidence") < 0.85), "low_confidence")
        .when(first_tier & F.col("audit_reason").eqNullSafe(F.lit("partial_data")), "partial_data")
        .when(first_tier & ~F.coalesce("plausible", F.lit(True)), "low_plausibility")
    )
    route = F.when(F.col("gate_reason").isNull(), "valid").when((F.col("attempts") >= most) | (F.coalesce("fallback_tier", F.lit("")) == "hitl"), "hitl").otherwise("retry")
    df = df.withColumn("gate_reason", reason).withColumn("route", route)
    return df.withColumn("final_status", F.when(F.col("route") == "valid", "verified").when(F.col("route") == "hitl", "review_pending").otherwise("processing"))


#: States a document may go to from each state; the last three are ends.
TRANSITIONS = {
    "received": ("preprocessed", "failed"),
    "preprocessed": ("locally_parsed", "vlm_reconciled", "failed"),
    "locally_parsed": ("verified", "vlm_reconciled", "flagged", "failed"),
    "vlm_reconciled": ("verified", "flagged", "failed"),
    "verified": (),
    "flagged": (),
    "failed": (),
}
#: How these states are stored.
STORED = {"received": "uploaded", "preprocessed": "preprocessing", "locally_parsed": "locally_parsed", "vlm_reconciled": "vlm_reconciled", "verified": "verified", "flagged": "review_pending", "failed": "failed"}


def stored_status(state: Column) -> Column:
    return F.coalesce(*[F.when(state == k, v) for k, v in STORED.items()])


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Steps of a log (key, ts, seq, status) that aren't allowed; a state without successors allows none."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    steps = log.withColumn("before", F.lag("status").over(w)).where("before is not null")
    allowed = log.sparkSession.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, status string")
    return steps.join(F.broadcast(allowed), ["before", "status"], "left_anti").select("key", "ts", "seq", "before", "status")
