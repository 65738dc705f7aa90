"""Ledger aggregates: spend, trust, vendor risk, compliance, service levels, batches, traces.

Child tables are summed per document before any join, so fields, items and corrections never multiply,
and each needs one exchange on document_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import amt_float
from ..sources.ledger import REQUIRED, Ledger
from ..sources.shared import shared_folder
from .documents import correction_counts, document_items, field_values, upsert
from .ranks import counted, percentile

MONTH_STATES = ("approved", "review_pending", "rejected")
PRIORITIES = ("Auto-Approve Candidate", "Needs Human Review", "Escalate", "Reject / Incomplete")


def processing_stats(ap: Ledger) -> DataFrame:
    return ap.documents.groupBy("status").agg(F.count("*").alias("documents"))


def _vendor_amounts(ap: Ledger) -> DataFrame:
    values = field_values(ap, "vendor_name", "total_amount")
    return values.select("document_id", "vendor_name", F.coalesce(amt_float(F.col("total_amount")), F.lit(0.0)).alias("amount"))


def spend_by_vendor(ap: Ledger) -> DataFrame:
    """Vendors as they are written; amounts that are no floats add 0; no vendor, no row."""
    named = _vendor_amounts(ap).where(F.coalesce("vendor_name", F.lit("")) != "")
    return named.groupBy("vendor_name").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total_spend"), F.count("*").alias("documents"))


def spend_by_month(ap: Ledger) -> DataFrame:
    docs = ap.documents.where(F.col("status").isin(*MONTH_STATES)).select(F.col("id").alias("document_id"), F.coalesce(F.date_format("uploaded_at", "yyyy-MM"), F.lit("unknown")).alias("month"))
    spend = docs.join(_vendor_amounts(ap), "document_id", "left")
    return spend.groupBy("month").agg(F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total_spend"), F.count("*").alias("documents"))


def monthly_trend(ap: Ledger, months: int = 12) -> DataFrame:
    return spend_by_month(ap).orderBy(F.desc("month")).limit(months)


def document_facts(ap: Ledger) -> DataFrame:
    """Per document what its fields, items and corrections sum up to, in one aggregate of each: c (mean confidence), n_invalid, invalid_names (the first four
    by created_at and id), the first values of required fields, valued (it has a vendor's or an amount's field), items and corrections."""
    first = lambda n: F.min_by(F.when(F.col("field_name") == n, F.col("field_value")), F.when(F.col("field_name") == n, F.struct("created_at", "id")))
    fields = ap.fields.groupBy("document_id").agg(
        F.avg("confidence").alias("c"),
        F.count_if(F.col("status") == "invalid").alias("n_invalid"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("status") == "invalid", F.struct("created_at", "id", "field_name")))), 1, 4), lambda x: x["field_name"]).alias("invalid_names"),
        *[first(n).alias(n) for n in REQUIRED],
        F.bool_or(F.col("field_name").isin("vendor_name", "total_amount")).alias("valued"),
    )
    docs = ap.documents.select(F.col("id").alias("document_id"))
    out = docs.join(fields, "document_id", "left").join(document_items(ap), "document_id", "left").join(correction_counts(ap), "document_id", "left")
    return out.fillna({"n_invalid": 0, "n_corrections": 0, "valued": False})


def document_stats(ap: Ledger, facts: DataFrame | None = None) -> DataFrame:
    """Mean field confidence, amount and corrections of each document."""
    if facts is not None:
        return facts.select("document_id", F.col("c").alias("avg_confidence"), F.when(F.col("valued"), F.coalesce(amt_float(F.col("total_amount")), F.lit(0.0))).alias("amount"), "n_corrections")
    conf = ap.fields.groupBy("document_id").agg(F.avg("confidence").alias("avg_confidence"))
    docs = ap.documents.select(F.col("id").alias("document_id"))
    out = docs.join(conf, "document_id", "left").join(_vendor_amounts(ap).select("document_id", "amount"), "document_id", "left").join(correction_counts(ap), "document_id", "left")
    return out.fillna({"n_corrections": 0})


def validation_breakdown(ap: Ledger) -> DataFrame:
    return ap.fields.where("status = 'invalid'").groupBy("field_name").agg(F.count("*").alias("invalid")).orderBy(F.desc("invalid"), "field_name")


def compliance(ap: Ledger, facts: DataFrame | None = None) -> DataFrame:
    """One row: correction rate in percent, corrections a document, documents with and without."""
    n = F.count("*")
    with_c = F.count_if(F.col("n_corrections") > 0)
    return document_stats(ap, facts).agg(
        F.coalesce(F.round(with_c / F.nullif(n, F.lit(0)) * 100, 2), F.lit(0.0)).alias("correction_rate"),
        F.coalesce(F.round(F.sum("n_corrections") / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("avg_corrections"),
        with_c.alias("with_corrections"),
        F.count_if(F.col("n_corrections") == 0).alias("without_corrections"),
    )


def supplier_metrics(ap: Ledger) -> DataFrame:
    """Per vendor: documents, mean of documents' mean confidence (0 for none), corrections; the risk score is to be set anew."""
    named = document_stats(ap).join(field_values(ap, "vendor_name"), "document_id").where(F.coalesce("vendor_name", F.lit("")) != "")
    return named.groupBy(F.col("vendor_name").alias("supplier_name")).agg(
        F.count("*").alias("total_documents"),
        F.round(F.coalesce(F.avg("avg_confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        F.sum("n_corrections").alias("total_corrections"),
        F.lit(None).cast("double").alias("risk_score"),
    )


def update_supplier_metrics(target: DataFrame, ap: Ledger) -> DataFrame:
    """target with every vendor's figures put in, one row a vendor."""
    return upsert(target, supplier_metrics(ap), ["supplier_name"], "total_documents")


def level(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 30, "low").when(score < 60, "medium").otherwise("high")


def supplier_list(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("risk_level", level(F.col("risk_score")))


def supplier_risk(metrics: DataFrame) -> DataFrame:
    """Heuristic risk: little confidence and few documents."""
    raw = (1 - F.col("avg_confidence")) * 60 + (1 - F.least(F.col("total_documents") / 10, F.lit(1.0))) * 40
    return metrics.withColumn("risk_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2))


PENALTIES = ("p_confidence", "p_very_low", "p_invalid", "p_missing", "p_corrections", "p_mismatch")


def trust_scores(ap: Ledger, facts: DataFrame | None = None) -> DataFrame:
    """Trust of every document, 0 to 100, with penalties (to one decimal), reasons and priority; documents without fields get a row too.

    Of invalid fields the first four are named, by (created_at, id).
    """
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", F.lit(f)) for f in REQUIRED]))
    df = (document_facts(ap) if facts is None else facts).withColumn("missing_fields", missing)
    df = df.withColumn("n_missing", F.size("missing_fields")).withColumn("amount", F.when(F.coalesce("total_amount", F.lit("")) != "", amt_float(F.col("total_amount"))))
    off = F.col("n_items").isNotNull() & F.col("amount").isNotNull() & ~F.isnan("amount") & (F.abs(F.col("items_total").cast("double") - F.col("amount")) >= 0.01)
    df = df.withColumn("mismatch", F.coalesce(off, F.lit(False)))
    df = df.withColumns(
        {
            "p_confidence": F.when(F.col("c").isNull(), 15.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(30.0), (1 - F.col("c")) * 30))),
            "p_very_low": F.when(F.col("c") < 0.5, 8.0).otherwise(0.0),
            "p_invalid": F.least(F.lit(20.0), 7.0 * F.col("n_invalid")),
            "p_missing": F.least(F.lit(25.0), 8.0 * F.col("n_missing")),
            "p_corrections": F.least(F.lit(15.0), 5.0 * F.col("n_corrections")),
            "p_mismatch": F.when(F.col("mismatch"), 12.0).otherwise(0.0),
        }
    )
    total = F.col("p_confidence") + F.col("p_very_low") + F.col("p_invalid") + F.col("p_missing") + F.col("p_corrections") + F.col("p_mismatch")
    df = df.withColumn("trust_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - total, 0).cast("int"))))
    score = F.col("trust_score")
    priority = (
        F.when((F.col("n_missing") >= 2) | (score < 25), PRIORITIES[3])
        .when((score < 50) | F.col("mismatch") | (F.col("n_invalid") >= 2) | (F.col("n_corrections") >= 3), PRIORITIES[2])
        .when((score < 80) | (F.col("n_invalid") > 0) | (F.col("n_corrections") > 0) | (F.col("n_missing") > 0), PRIORITIES[1])
        .otherwise(PRIORITIES[0])
    )
    percent = F.format_string("%.1f", F.bround(F.round(F.col("c") * 100, 6), 1))
    # The reasons' texts.
    reasons = F.array_compact(
        F.array(
            F.when(F.col("c").isNull(), "Confidence data unavailable (no fields extracted)")
            .when(F.round("p_confidence", 6) > 20, F.concat(F.lit("Low extraction confidence ("), percent, F.lit("%) — high OCR uncertainty")))
            .when(F.round("p_confidence", 6) > 8, F.concat(F.lit("Moderate extraction confidence ("), percent, F.lit("%)"))),
            F.when(F.col("c") < 0.5, "Confidence critically below 50% — result reliability is low"),
            F.when(F.col("n_invalid") > 0, F.concat(F.col("n_invalid").cast("string"), F.lit(" invalid field(s): "), F.array_join("invalid_names", ", "))),
            F.when(F.col("n_missing") > 0, F.concat(F.lit("Missing required field(s): "), F.array_join(F.sort_array("missing_fields"), ", "))),
            F.when(F.col("n_corrections") > 0, F.concat(F.col("n_corrections").cast("string"), F.lit(" human correction(s) required during review"))),
            F.when(F.col("mismatch"), "Line-item sum does not match declared invoice total"),
        )
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("All quality checks passed")))
    shown = lambda c: F.bround(F.round(c, 6), 1).alias(c)
    return df.select("document_id", "trust_score", priority.alias("priority"), reasons.alias("reasons"), "c", "n_invalid", "n_missing", "n_corrections", "mismatch", *map(shown, PENALTIES))


#: Score ranges of the distribution.
RANGES = ((0, 20, "0-20"), (21, 40, "21-40"), (41, 60, "41-60"), (61, 80, "61-80"), (81, 100, "81-100"))


def trust_overview(trust: DataFrame) -> DataFrame:
    """One row: number, mean trust, both distributions as arrays of (label, n), and a message if there are none."""
    entry = lambda label, cond: F.struct(F.lit(label).alias("label"), F.count_if(cond).alias("n"))
    buckets = [entry(name, F.col("trust_score").between(bottom, top)) for bottom, top, name in RANGES]
    return trust.agg(
        F.count("*").alias("documents"), F.round(F.avg("trust_score"), 1).alias("avg_trust"), F.array(*buckets).alias("distribution"),
        F.array(*[entry(p, F.col("priority") == p) for p in PRIORITIES]).alias("priorities"), F.when(F.count("*") == 0, "No documents").alias("message"),
    )


def _histogram(spark_rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    return spark_rows.join(counts, key, "left").fillna({"documents": 0})


def trust_distribution(trust: DataFrame) -> DataFrame:
    """Documents in five score ranges; empty ranges stay."""
    bounds = [(top, name) for _, top, name in RANGES]
    bucket = F.coalesce(*[F.when(F.col("trust_score") <= top, name) for top, name in bounds])
    ranges = trust.sparkSession.createDataFrame([(n, i) for i, (_, n) in enumerate(bounds)], "bucket string, pos int")
    return _histogram(ranges, trust.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents")), "bucket")


def priority_distribution(trust: DataFrame) -> DataFrame:
    order = trust.sparkSession.createDataFrame([(p, i) for i, p in enumerate(PRIORITIES)], "priority string, pos int")
    return _histogram(order, trust.groupBy("priority").agg(F.count("*").alias("documents")), "priority")


def flagged(trust: DataFrame) -> DataFrame:
    rank = F.when(F.col("priority") == PRIORITIES[3], 0).when(F.col("priority") == PRIORITIES[2], 1).otherwise(2)
    return trust.where(F.col("priority") != PRIORITIES[0]).select("document_id", "trust_score", "priority", rank.alias("pos")).orderBy("pos", "trust_score", "document_id")


def vendor_risk(ap: Ledger, trust: DataFrame, with_documents: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Risk of each (trimmed) vendor, riskiest first. The list of documents is optional: it grows with the vendor."""
    vendors = (field_values(ap, "vendor_name", "total_amount") if facts is None else facts).select("document_id", F.trim("vendor_name").alias("vendor"), amt_float(F.col("total_amount")).alias("amount")).where("vendor <> ''")
    amount = F.when(F.col("amount") > 0, F.col("amount"))
    aggs = [
        F.count("*").alias("documents"),
        F.sum("n_corrections").alias("total_corrections"),
        F.avg("n_corrections").alias("avg_corrections"),
        *[F.count_if(c).alias(n) for n, c in (("with_invalid", F.col("n_invalid") > 0), ("low_trust", F.col("trust_score") < 50), ("with_missing", F.col("n_missing") > 0))],
        F.avg((F.col("n_invalid") > 0).cast("int")).alias("invalid_share"),
        F.avg((F.col("trust_score") < 50).cast("int")).alias("low_share"),
        F.avg((F.col("n_missing") > 0).cast("int")).alias("missing_share"),
        F.when(F.count(amount) >= 2, F.stddev_pop(amount) / F.avg(amount)).otherwise(0.0).alias("cv"),
        F.round(F.avg("trust_score"), 1).alias("avg_trust"),
    ]
    if with_documents:
        aggs.append(F.sort_array(F.collect_list("document_id")).alias("document_ids"))
    df = vendors.join(trust, "document_id").groupBy("vendor").agg(*aggs)
    df = df.withColumns(
        {
            "p_corrections": F.round(F.least(F.lit(25.0), 12 * F.col("avg_corrections")), 2),
            "p_invalid": F.round(25 * F.col("invalid_share"), 2),
            "p_low_trust": F.round(20 * F.col("low_share"), 2),
            "p_variation": F.round(F.least(F.lit(20.0), 20 * F.col("cv")), 2),
            "p_missing": F.round(10 * F.col("missing_share"), 2),
        }
    )
    total = F.col("p_corrections") + F.col("p_invalid") + F.col("p_low_trust") + F.col("p_variation") + F.col("p_missing")
    score = F.col("risk_score")
    df = df.withColumn("risk_score", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(total, 6), 0).cast("int")))).withColumn("risk_level", level(score))
    # Actions and reasons' texts.
    action = (
        F.when(score >= 70, "Escalate for compliance review — multiple risk factors present")
        .when(score >= 50, "Flag for senior reviewer — moderate risk detected")
        .when(score >= 30, "Standard review recommended")
        .otherwise("Low risk — standard processing")
    )
    text = lambda c, places: F.format_string(f"%.{places}f", F.bround(F.round(c, 8), places))
    average, share, spread = text(F.col("avg_corrections"), 1), text(F.col("invalid_share") * 100, 0), text(F.col("cv"), 2)
    of_all = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("documents").cast("string"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("avg_corrections") >= 2, F.concat(F.lit("High correction rate: avg "), average, F.lit(" corrections per document"))).when(F.col("avg_corrections") >= 1, F.concat(F.lit("Repeated human corrections: avg "), average, F.lit(" per document"))),
            F.when(F.col("invalid_share") >= 0.5, F.concat(of_all("with_invalid"), F.lit(" documents had invalid fields ("), share, F.lit("%)"))).when(F.col("invalid_share") > 0, F.concat(F.lit("Some documents contained invalid fields ("), share, F.lit("%)"))),
            F.when(F.col("low_trust") > 0, F.concat(of_all("low_trust"), F.lit(" documents scored below 50 on trust"))),
            F.when(F.col("cv") > 0.5, F.concat(F.lit("High invoice amount variability (CV="), spread, F.lit(") — possible duplicate or outlier invoices"))).when(F.col("cv") > 0.3, F.concat(F.lit("Moderate invoice amount variability (CV="), spread, F.lit(")"))),
            F.when(F.col("with_missing") > 0, F.concat(of_all("with_missing"), F.lit(" documents had missing required fields"))),
        )
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("No significant risk signals detected"))).alias("reasons")
    keep = ["vendor", "documents", "risk_score", "risk_level", "avg_trust", "total_corrections", *[c for c in df.columns if c.startswith("p_")], reasons]
    return df.select(*keep, action.alias("action"), *(["document_ids"] if with_documents else [])).orderBy(F.desc("risk_score"), "vendor")


def stored_facts(ap: Ledger) -> DataFrame:
    """document_facts as a table: what is derived from it is planned apart, and would go over the fields anew."""
    facts = document_facts(ap)
    path = shared_folder(facts.sparkSession, "facts")
    facts.write.parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)


def dashboard(ap: Ledger) -> DataFrame:
    """One row of totals, with documents by status and invalid fields by name (arrays of a label and a count), anomalies and compliance."""
    from .forecast import anomalies

    facts = stored_facts(ap)
    trust = trust_scores(ap, facts)
    listed = lambda df, label, n: df.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col(n).alias("n")))))
    by_status = listed(processing_stats(ap), "status", "documents").toDF("documents_by_status")
    by_field = listed(validation_breakdown(ap), "field_name", "invalid").toDF("validation_failures")
    odd = anomalies(document_stats(ap, facts)).agg(F.count("*").alias("anomalies"))
    with_corrections = compliance(ap, facts).select("correction_rate", "avg_corrections", "with_corrections", "without_corrections")
    docs = trust.agg(
        F.count("*").alias("documents"), F.round(F.avg("trust_score"), 1).alias("avg_trust"), F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 3).alias("avg_confidence"),
        F.round(F.coalesce(F.count_if(F.col("n_invalid") == 0) / F.nullif(F.count("*"), F.lit(0)) * 100, F.lit(0.0)), 2).alias("compliance_rate"),
        F.count_if(F.col("priority") != PRIORITIES[0]).alias("needs_review"), F.count_if(F.col("priority") == PRIORITIES[2]).alias("escalate"), F.count_if(F.col("priority") == PRIORITIES[3]).alias("reject"),
        F.count_if(F.col("n_invalid") > 0).alias("compliance_exceptions"),
    )
    spend = spend_by_vendor(ap).agg(F.round(F.coalesce(F.sum(F.col("total_spend").cast("decimal(28,2)")), F.lit(0)), 2).cast("double").alias("total_spend"))
    high = vendor_risk(ap, trust, facts=facts).agg(F.count_if(F.col("risk_level") == "high").alias("high_risk_vendors"))
    for one in (spend, high, by_status, by_field, odd, with_corrections):
        docs = docs.crossJoin(F.broadcast(one))  # one row each
    return docs


def sla(ap: Ledger, target_hours: int = 24) -> DataFrame:
    seconds = lambda c: F.unix_timestamp(c) - F.unix_timestamp("uploaded_at")
    return ap.documents.agg(
        F.round(F.avg(seconds("processed_at")), 2).alias("avg_processing_s"),
        F.round(F.avg(seconds("approved_at")), 2).alias("avg_approval_s"),
        F.count_if(seconds("approved_at") > target_hours * 3600).alias("breaches"),
    )


def throughput(ap: Ledger, now: str, days: int = 30) -> DataFrame:
    """Uploads a day in the days before now."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    recent = ap.documents.where((F.col("uploaded_at") >= since) & (F.col("uploaded_at") <= F.lit(now).cast("timestamp")))
    return recent.groupBy(F.date_format("uploaded_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("documents"))


def correction_patterns(ap: Ledger, k: int = 10) -> DataFrame:
    names = ap.fields.select(F.col("id").alias("field_id"), "field_name")
    return ap.corrections.join(names, "field_id").groupBy("field_name").agg(F.count("*").alias("corrections")).orderBy(F.desc("corrections"), "field_name").limit(k)


def confidence_drift(ap: Ledger, now: str, days: int = 30) -> DataFrame:
    """Daily mean of documents' confidence, else their fields' mean; documents with neither are left out."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))
    recent = ap.documents.where((F.col("uploaded_at") >= since) & (F.col("uploaded_at") <= F.lit(now).cast("timestamp"))).select(F.col("id").alias("document_id"), "uploaded_at", "confidence_score")
    means = ap.fields.groupBy("document_id").agg(F.avg("confidence").alias("mean_conf"))
    conf = recent.join(means, "document_id", "left").withColumn("conf", F.coalesce("confidence_score", "mean_conf")).where("conf is not null")
    return conf.groupBy(F.date_format("uploaded_at", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("conf"), 3).alias("avg_confidence"), F.count("*").alias("documents"))


BATCH_STATES = ("uploaded", "processing", "extracted", "verified", "review_pending", "approved", "rejected", "failed")


def batch_status(ap: Ledger) -> DataFrame:
    """Per batch: documents in each state, filled fields, items."""
    filled = ap.fields.where(F.coalesce("field_value", F.lit("")) != "").groupBy("document_id").agg(F.count("*").alias("n_fields"))
    docs = ap.documents.where("batch_id is not null").select(F.col("id").alias("document_id"), "batch_id", "status")
    df = docs.join(filled, "document_id", "left").join(document_items(ap).select("document_id", "n_items"), "document_id", "left")
    return df.groupBy("batch_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in BATCH_STATES], F.coalesce(F.sum("n_fields"), F.lit(0)).alias("fields"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"), F.count("*").alias("documents"))


def finalize_batches(ap: Ledger) -> DataFrame:
    """A batch ends once no document is uploaded or processing: partial_failed if any failed, else completed."""
    df = ap.batches.select(F.col("id").alias("batch_id"), F.col("status").alias("old")).join(batch_status(ap), "batch_id", "left")
    over = F.col("old").isin("completed", "partial_failed") | F.col("documents").isNull() | (F.col("uploaded") + F.col("processing") > 0)
    return df.select("batch_id", F.when(over, F.col("old")).when(F.col("failed") > 0, "partial_failed").otherwise("completed").alias("status"))


TRACE = "array<struct<stage:string,ok:boolean,reason:string,detail:map<string,string>>>"


def trace_stats(ap: Ledger) -> DataFrame:
    """Per stage of the traceability logs: entries, ok share, reasons, median elapsed time."""
    t = ap.documents.select(F.explode(F.from_json("traceability_log", TRACE)).alias("t")).select("t.stage", "t.reason", "t.ok", F.try_element_at("t.detail", F.lit("elapsed_ms")).try_cast("double").alias("ms"))
    medians = counted(t, "ms", "stage", "reason").groupBy("stage", "reason").agg(percentile("ms", 0.5).alias("median_ms"))
    all_ = t.groupBy("stage", "reason").agg(F.count("*").alias("entries"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("ok_share"))
    same = F.col("a.stage").eqNullSafe(F.col("m.stage")) & F.col("a.reason").eqNullSafe(F.col("m.reason"))
    return all_.alias("a").join(medians.alias("m"), same, "left").select("a.*", "m.median_ms")


def last_confidence(ap: Ledger) -> DataFrame:
    """The last numeric confidence in each document's log."""
    t = ap.documents.select("id", F.posexplode(F.from_json("traceability_log", TRACE)).alias("pos", "t"))
    conf = F.try_element_at("t.detail", F.lit("confidence")).try_cast("double")
    return t.withColumn("conf", conf).where("conf is not null").groupBy(F.col("id").alias("document_id")).agg(F.max_by("conf", "pos").alias("confidence"))


def analytics_summaries(summaries: DataFrame, metric: str | None = None) -> DataFrame:
    return summaries if metric is None else summaries.where(F.col("metric_name") == metric)
