"""Per-document jobs: wide rows, feeds, listings, corrections, approvals, training joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amt_bi, amt_float
from ..sources.ledger import FIELDS, Ledger
from ..sources.shared import stored


def field_values(ap: Ledger, *names: str) -> DataFrame:
    """One row per document and a column per field: the first value by (created_at, id) where a name repeats.

    One exchange on document_id; each value is a min_by, combined before the shuffle.
    """
    first = lambda n: F.min_by(F.when(F.col("field_name") == n, F.col("field_value")), F.when(F.col("field_name") == n, F.struct("created_at", "id")))
    return ap.fields.where(F.col("field_name").isin(*names)).groupBy("document_id").agg(*[first(n).alias(n) for n in names])


def invoice_wide(ap: Ledger) -> DataFrame:
    """Six texts and the items, as texts in id order, of each document that has any field."""
    item = F.struct("id", "description", *[F.col(c).cast("string").alias(c) for c in ("quantity", "unit_price", "total")])
    items = ap.line_items.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return field_values(ap, *FIELDS).join(items, "document_id", "left")


def document_items(ap: Ledger) -> DataFrame:
    """Number and sum (exact, from two decimals) of each document's items."""
    return ap.line_items.groupBy("document_id").agg(F.count("*").alias("n_items"), F.sum(F.coalesce(F.col("total"), F.lit(0.0)).cast("decimal(18,2)")).alias("items_total"))


def correction_counts(ap: Ledger) -> DataFrame:
    return ap.corrections.groupBy("document_id").agg(F.count("*").alias("n_corrections"))


def bi_line_items(ap: Ledger) -> DataFrame:
    return ap.line_items.select("document_id", "description", "quantity", "unit_price", "total")


def bi_corrections(ap: Ledger) -> DataFrame:
    """Corrections with their field's name, null where the field is gone."""
    names = ap.fields.select(F.col("id").alias("field_id"), "field_name")
    return ap.corrections.join(names, "field_id", "left").select("document_id", "field_name", "original_value", "corrected_value", "reviewed_by", "created_at")


def bi_invoices(ap: Ledger, trust: DataFrame) -> DataFrame:
    """One row per document: vendor, amount, trust, priority, tier, confidence and times."""
    values = field_values(ap, "vendor_name", "total_amount")
    base = ap.documents.select(F.col("id").alias("document_id"), "original_filename", "status", "fallback_tier", "confidence_score", "uploaded_at", "processed_at", "approved_at")
    return base.join(values, "document_id", "left").join(trust.select("document_id", "trust_score", "priority"), "document_id", "left").withColumn("amount", amt_bi(F.col("total_amount"))).drop("total_amount")


def list_documents(ap: Ledger, user: str, include_all: bool = False, batch: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A user's documents (all, for the privileged), newest first, with the total before paging."""
    docs = ap.documents if include_all else ap.documents.where(F.col("uploaded_by") == user)
    docs = docs if batch is None else docs.where(F.col("batch_id") == batch)
    total = docs.agg(F.count("*").alias("total"))
    page = docs.orderBy(F.desc_nulls_last("uploaded_at"), "id").offset(skip).limit(limit)
    return page.select("id", "original_filename", "status", "uploaded_at").crossJoin(F.broadcast(total))  # one row


def display_status(status: Column) -> Column:
    """Stored state to what is shown; null is failed."""
    return (
        F.when(status.isNull(), "failed")
        .when(status == "verified", "review_pending")
        .when(status.isin("locally_parsed", "vlm_reconciled"), "extracting")
        .otherwise(status)
    )


def requeue(ap: Ledger, batch: str | None = None) -> DataFrame:
    docs = ap.documents.where(F.col("status").isin("uploaded", "failed"))
    return (docs if batch is None else docs.where(F.col("batch_id") == batch)).select("id", "batch_id", "status")


def list_batches(ap: Ledger, user: str | None = None, limit: int = 5) -> DataFrame:
    return (ap.batches if user is None else ap.batches.where(F.col("created_by") == user)).orderBy(F.desc("created_at"), "id").limit(limit)


def admit_batches(manifest: DataFrame, extensions: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg"), max_mb: int = 50, max_files: int = 20) -> DataFrame:
    """manifest (batch_id, filename, size): per batch whether all files may come in, and how many fail."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./]*)$", 1))
    bad = ~ext.isin(*extensions) | (F.col("size") > max_mb * 1024 * 1024)
    out = manifest.groupBy("batch_id").agg(F.count("*").alias("files"), F.count_if(bad).alias("rejected"))
    return out.withColumn("admitted", (F.col("rejected") == 0) & F.col("files").between(1, max_files))


def apply_corrections(ap: Ledger, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edits (id, document_id, field_id, corrected_value, reviewed_by, created_at) -> (fields, corrections, rejects).

    Edits of fields that don't exist or belong to another document are rejected. Several edits of a field
    apply in order of (created_at, id): each logs the value before it, and the last one stays.
    """
    names = ap.fields.select(F.col("id").alias("field_id"), F.col("document_id").alias("owner"), "field_value")
    known = edits.join(names, "field_id", "left")
    good = known.where(F.col("owner").eqNullSafe(F.col("document_id")) & F.col("owner").isNotNull())
    rejects = known.where(F.col("owner").isNull() | (F.col("owner") != F.col("document_id"))).select(*edits.columns)
    w = Window.partitionBy("field_id").orderBy("created_at", "id")
    log = good.withColumn("original_value", F.coalesce(F.lag("corrected_value").over(w), F.col("field_value")))
    last = good.groupBy("field_id").agg(F.max_by("corrected_value", F.struct("created_at", "id")).alias("new_value"))
    fields = ap.fields.join(last.withColumnRenamed("field_id", "id"), "id", "left")
    changed = F.col("new_value").isNotNull()
    fields = fields.withColumns({"field_value": F.when(changed, F.col("new_value")).otherwise(F.col("field_value")), "status": F.when(changed, "corrected").otherwise(F.col("status")), "error_message": F.when(~changed, F.col("error_message"))}).drop("new_value")
    return fields, log.select("id", "document_id", "field_id", "original_value", "corrected_value", "reviewed_by", "created_at"), rejects


def validation_summary(ap: Ledger) -> DataFrame:
    """Fields by status per document; resolved: nothing invalid or pending."""
    n = lambda s: F.count_if(F.col("f_status") == s).alias(f"n_{s}")
    fields = ap.fields.select("document_id", F.col("status").alias("f_status"))
    out = ap.documents.select(F.col("id").alias("document_id")).join(fields, "document_id", "left").groupBy("document_id").agg(*map(n, ("valid", "invalid", "corrected", "pending")))
    return out.withColumn("all_resolved", (F.col("n_invalid") == 0) & (F.col("n_pending") == 0))


def approve(ap: Ledger, requests: DataFrame, at: str) -> DataFrame:
    """requests (document_id, user): documents without invalid or pending fields become approved; others keep their state, allowed = false."""
    allowed = requests.join(validation_summary(ap).select("document_id", "all_resolved"), "document_id")
    docs = ap.documents.join(allowed.withColumnRenamed("document_id", "id"), "id")
    ok = F.col("all_resolved")
    return docs.select("id", ok.alias("allowed"), F.when(ok, "approved").otherwise(F.col("status")).alias("status"), F.when(ok, F.col("user")).otherwise(F.col("approved_by")).alias("approved_by"), F.when(ok, F.lit(at).cast("timestamp")).otherwise(F.col("approved_at")).alias("approved_at"))


def reject(ap: Ledger, requests: DataFrame) -> DataFrame:
    """requests (document_id, reason): rejected documents."""
    return ap.documents.join(requests.withColumnRenamed("document_id", "id"), "id").select("id", F.lit("rejected").alias("status"), F.col("reason").alias("rejected_reason"))


def document_corrections(ap: Ledger) -> DataFrame:
    return ap.corrections.select("document_id", "field_id", "original_value", "corrected_value", "reviewed_by", "created_at")


def merge_items(fast: DataFrame, second: DataFrame) -> DataFrame:
    """Line items of two extractors (with document_id): a document's items are the second's if it has any."""
    return second.unionByName(fast.join(second.select("document_id"), "document_id", "left_anti"))


def merge_tiers(fast: DataFrame, second: DataFrame, thresholds: DataFrame, default: float = 0.5) -> DataFrame:
    """(document_id, field_name, field_value, confidence) of two extractors: a low fast field gives way to a surer second one."""
    f = fast.select("document_id", "field_name", F.col("field_value").alias("f_value"), F.col("confidence").alias("f_conf"))
    s = second.select("document_id", "field_name", F.col("field_value").alias("s_value"), F.col("confidence").alias("s_conf"))
    both = f.join(s, ["document_id", "field_name"], "full").join(F.broadcast(thresholds), "field_name", "left")  # a row per field name
    low = F.coalesce("f_conf", F.lit(1.0)) < F.coalesce("threshold", F.lit(default))
    take = F.col("f_value").isNull() | (F.col("s_value").isNotNull() & low & (F.coalesce("s_conf", F.lit(0.0)) > F.coalesce("f_conf", F.lit(0.0))))
    pick = lambda c: F.when(take, F.col(f"s_{c}")).otherwise(F.col(f"f_{c}"))
    return both.select("document_id", "field_name", pick("value").alias("field_value"), pick("conf").alias("confidence"), F.when(take, "second").otherwise("fast").alias("source"))


def earliest_correction(corrections: DataFrame) -> DataFrame:
    """The first correction of each field, by (created_at, id)."""
    key = F.struct("created_at", "id")
    return corrections.groupBy("field_id").agg(F.min_by("original_value", key).alias("original_value"), F.min_by("corrected_value", key).alias("corrected_value"), F.min("created_at").alias("created_at"), F.min_by("document_id", key).alias("document_id"))


def clean_documents(ap: Ledger, limit: int | None = None) -> DataFrame:
    """Verified, never corrected, with fields: all, or the newest by processing."""
    docs = ap.documents.where("status = 'verified'").withColumnRenamed("id", "document_id")
    docs = docs.join(ap.corrections.select("document_id"), "document_id", "left_anti").join(ap.fields.select("document_id"), "document_id", "left_semi")
    docs = docs if limit is None else docs.orderBy(F.desc_nulls_last("processed_at"), "document_id").limit(limit)
    return docs.select("document_id", "processed_at")


def correction_pairs(ap: Ledger, limit: int | None = None) -> DataFrame:
    """Corrected documents (all, or the first by id): each field after (as it is) and before (the first correction's original value)."""
    docs = ap.corrections.select("document_id").distinct()
    docs = docs if limit is None else docs.orderBy("document_id").limit(limit)
    fields = ap.fields.join(docs, "document_id", "left_semi")
    before = earliest_correction(ap.corrections).select(F.col("field_id").alias("id"), F.col("original_value").alias("before"))
    both = fields.join(before, "id", "left").withColumn("before", F.coalesce("before", "field_value"))
    first = lambda n: F.min_by(F.when(F.col("field_name") == n, F.struct("before", "field_value")), F.when(F.col("field_name") == n, F.struct("created_at", "id")))
    values = both.groupBy("document_id").agg(*[first(n).alias(n) for n in FIELDS])
    return values.select("document_id", *[F.col(n)[c].alias(f"{when}_{n}") for n in FIELDS for when, c in (("before", "before"), ("after", "field_value"))])


def corrected_wide(ap: Ledger, wide: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(before, after) of all corrected documents, each as wide rows; items are the same in both. wide: invoice_wide, if it is there. The pairs are a stored table."""
    wide = invoice_wide(ap) if wide is None else wide
    pairs = stored(correction_pairs(ap), "correction-pairs")  # its shuffles are gone before the items are dealt
    pairs = stored(pairs.join(wide.select("document_id", "items"), "document_id", "left"), "corrected")
    of = lambda when: pairs.select("document_id", *[F.col(f"{when}_{n}").alias(n) for n in FIELDS], "items")
    return of("before"), of("after")


def correction_text_pairs(ap: Ledger, limit: int | None = None) -> DataFrame:
    """(tier, field, model value, human value) of first corrections: all, or the newest."""
    first = earliest_correction(ap.corrections)
    named = first.join(ap.fields.select(F.col("id").alias("field_id"), "field_name"), "field_id").join(ap.documents.select(F.col("id").alias("document_id"), "fallback_tier"), "document_id")
    top = named if limit is None else named.orderBy(F.desc("created_at"), "field_id").limit(limit)
    return top.select("field_id", F.coalesce("fallback_tier", F.lit("unknown")).alias("tier"), "field_name", F.col("original_value").alias("model_value"), F.col("corrected_value").alias("human_value"))


def holdouts(ap: Ledger, n: int) -> DataFrame:
    """The n newest corrected and the n newest verified, uncorrected documents."""
    docs = ap.documents.withColumnRenamed("id", "document_id")
    newest = lambda d, kind: d.orderBy(F.desc_nulls_last("processed_at"), "document_id").limit(n).select("document_id", F.lit(kind).alias("kind"))
    return newest(docs.join(ap.corrections, "document_id", "left_semi"), "corrected").unionByName(newest(docs.where("status = 'verified'").join(ap.corrections, "document_id", "left_anti"), "clean"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with rows of updates put in or over it; the last by order (of equal ones the largest row) wins per key, null keys match null keys."""
    rest = F.struct(*[c for c in updates.columns if c not in keys])
    last = updates.groupBy(*keys).agg(F.max_by(rest, F.struct(F.col(order), rest)).alias("u")).select(*keys, "u.*")
    t, u = target.alias("t"), last.select(*[F.col(k).alias(f"u_{k}") for k in keys])
    match = [F.col(f"t.{k}").eqNullSafe(F.col(f"u_{k}")) for k in keys]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return t.join(u, cond, "left_anti").unionByName(last.select(*target.columns))


def replace_for_documents(target: DataFrame, new: DataFrame) -> DataFrame:
    """target with all rows of new's documents replaced."""
    return target.join(new.select("document_id"), "document_id", "left_anti").unionByName(new.select(*target.columns))


def amounts(ap: Ledger) -> DataFrame:
    """Each document's amount as a float, null if it is none."""
    return field_values(ap, "total_amount").select("document_id", amt_float(F.col("total_amount")).alias("amount"))
