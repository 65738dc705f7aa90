"""Documents that go through audit, verifier and gate until they are valid or a person's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.audit import audit
from ..functions.text import REPLY_KEYS, parse_reply
from ..sources.ledger import FIELDS
from ..sources.shared import shared_folder, write_cleanly
from .review import MOST_ATTEMPTS, decided

STATE = ("document_id", *FIELDS, "items", "fallback_tier", "ocr_confidence", "attempts")


def reconcile(documents: DataFrame, replies: Callable[[int], DataFrame], verify: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """documents (document_id, the six fields, items, fallback_tier, ocr_confidence) with gate_reason, route (valid or hitl), final_status and attempts.

    Each round audits the open documents, asks the verifier (document_id, ok; of those whose route it can change) and the gate, and gives those it routes to retry their next reply:
    replies(attempt) has (document_id, reply, confidence). A reply that parses replaces all fields and items, and the OCR confidence; one that
    doesn't leaves them. Both are from the second tier from then on. Without a reply a document is a person's at once. A round is a stored table; there
    are at most ``most`` replies a document. Ids must not repeat; a null id gets no reply.
    """
    spark, path = documents.sparkSession, shared_folder(documents.sparkSession, "reconcile")
    kept = lambda df, name: (write_cleanly(df, f"{path}/{name}"), spark.read.schema(df.schema).parquet(f"{path}/{name}"))[1]
    open_, done = kept(documents.withColumn("attempts", F.lit(0)).select(*STATE), "0"), None
    for attempt in range(most + 1):
        filled = F.greatest(*[(F.coalesce(F.trim(f), F.lit("")) != "") for f in FIELDS])
        checked = audit(open_).withColumn("is_empty", ~filled)
        if verify:  # only of documents whose route it can change
            asked = decided(checked.withColumn("plausible", F.lit(False)), most).where("gate_reason = 'low_plausibility'")
            checked = checked.join(verify(asked.select(*STATE)).select("document_id", F.col("ok").alias("plausible")), "document_id", "left")
        else:
            checked = checked.withColumn("plausible", F.lit(True))
        judged = kept(decided(checked, most).select(*STATE, "gate_reason", "route", "final_status"), f"judged-{attempt}")
        ended = judged.where("route <> 'retry'")
        done = ended if done is None else done.unionByName(ended)
        again = judged.where("route = 'retry'").select(*STATE)
        if attempt == most or again.isEmpty():
            break
        reply = replies(attempt + 1).select("document_id", "reply", F.col("confidence").alias("new_confidence"), F.lit(True).alias("replied"))
        both = again.join(reply, "document_id", "left").withColumn("r", parse_reply(F.col("reply")))
        good = F.coalesce(F.col("replied"), F.lit(False)) & F.col("r.reason").isNull()
        new = {f: F.when(good, F.col(f"r.{f}")).otherwise(F.col(f)) for f in REPLY_KEYS}
        item = lambda x: F.struct(F.lit(None).cast("string").alias("id"), x["description"].alias("description"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), x["total"].alias("total"))
        new["items"] = F.when(good, F.transform(F.col("r.line_items"), item).cast(documents.schema["items"].dataType)).otherwise(F.col("items"))
        new |= {"ocr_confidence": F.when(good, F.col("new_confidence")).otherwise(F.col("ocr_confidence")), "fallback_tier": F.when(F.col("replied").isNull(), "hitl").otherwise("vlm"), "attempts": F.col("attempts") + 1}
        open_ = kept(both.withColumns(new).select(*STATE), str(attempt + 1))
    return done.select(*STATE, "gate_reason", "route", "final_status")
