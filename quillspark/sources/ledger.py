"""The accounts-payable ledger: declared schemas, the loader, and ledger views over sales tables.

The views use integer arithmetic, decimal casts and concatenation only, in SQL that both Spark and other
engines read alike; {name} stands for a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, original_filename string, file_size long, status string, uploaded_by string, uploaded_at timestamp, processed_at timestamp, approved_by string, approved_at timestamp, rejected_reason string, traceability_log string, fallback_tier string, confidence_score double, batch_id string",
    "fields": "id string, document_id string, field_name string, field_value string, confidence double, status string, error_message string, created_at timestamp",
    "line_items": "id string, document_id string, description string, quantity double, unit_price double, total double, created_at timestamp",
    "corrections": "id string, document_id string, field_id string, original_value string, corrected_value string, reviewed_by string, created_at timestamp",
    "batches": "id string, created_by string, created_at timestamp, status string, total_documents long",
}
#: The six fields of an invoice, and those that must be there.
FIELDS = ("invoice_number", "date", "vendor_name", "subtotal", "tax", "total_amount")
REQUIRED = ("invoice_number", "date", "vendor_name", "total_amount")


@dataclass(frozen=True)
class Ledger:
    documents: DataFrame
    fields: DataFrame
    line_items: DataFrame
    corrections: DataFrame
    batches: DataFrame


def load_ledger(spark: SparkSession, path: str) -> Ledger:
    """Parquet tables of the declared schemas, one folder each."""
    return Ledger(**{name: spark.read.schema(schema).parquet(f"{path}/{name}.parquet") for name, schema in SCHEMAS.items()})


VIEWS = {
    "ap_lines": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn
        FROM {lineitem}""",
    "ap_documents": """
        SELECT o_orderkey AS k, 'doc_' || o_orderkey AS id, 'inv_' || o_orderkey || '.pdf' AS original_filename, 1000 + (o_orderkey * 7919) % 90000 AS file_size,
          CASE WHEN o_orderkey % 10 <= 3 THEN 'approved' WHEN o_orderkey % 10 <= 5 THEN 'verified' WHEN o_orderkey % 10 <= 7 THEN 'review_pending' WHEN o_orderkey % 10 = 8 THEN 'rejected' ELSE 'failed' END AS status,
          'usr_' || o_custkey AS uploaded_by, CAST(o_orderdate AS TIMESTAMP) AS uploaded_at,
          CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + (1 + (37 * o_orderkey) % 600) * INTERVAL '1' MINUTE END AS processed_at,
          CASE WHEN o_orderkey % 10 <= 3 THEN 'usr_0' END AS approved_by,
          CASE WHEN o_orderkey % 10 <= 3 THEN CAST(o_orderdate AS TIMESTAMP) + (1 + (53 * o_orderkey) % 72) * INTERVAL '1' HOUR END AS approved_at,
          CASE WHEN o_orderkey % 10 = 8 THEN 'rejected in review' END AS rejected_reason,
          CASE WHEN o_orderkey % 5 <= 2 THEN 'local' WHEN o_orderkey % 5 = 3 THEN 'vlm' END AS fallback_tier,
          CASE WHEN o_orderkey % 7 <> 0 THEN ((13 * o_orderkey) % 100) / 100.0E0 END AS confidence_score,
          CASE WHEN o_orderkey % 4 <> 0 THEN 'bat_' || CAST(floor(o_orderkey / 15.0E0) AS BIGINT) END AS batch_id,
          '[{{"stage": "ocr", "ok": true, "reason": null, "detail": {{"elapsed_ms": "' || (100 + (11 * o_orderkey) % 900) || '"}}}}, {{"stage": "audit", "ok": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'true, "reason": null' ELSE 'false, "reason": "math_mismatch"' END || ', "detail": {{"confidence": "0.' || (10 + o_orderkey % 90) || '"}}}}]' AS traceability_log
        FROM {orders}""",
    "ap_line_items": """
        SELECT 'lin_' || l_orderkey || '_' || rn AS id, 'doc_' || l_orderkey AS document_id, p_name AS description, l_quantity AS quantity,
          floor(l_extendedprice * 100 / l_quantity) / 100.0E0 AS unit_price, l_extendedprice AS total, CAST(l_shipdate AS TIMESTAMP) AS created_at
        FROM {ap_lines} JOIN {part} ON p_partkey = l_partkey""",
    "ap_invoices": """
        SELECT k, subtotal, CASE WHEN k % 3 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(subtotal * 0.05 AS DECIMAL(18,2)) END AS tax, s_name AS vendor, CAST(uploaded_at AS DATE) AS day, uploaded_at
        FROM (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS subtotal, min_by(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS first_supplier FROM {lineitem} GROUP BY l_orderkey) s
        JOIN {ap_documents} ON k = l_orderkey JOIN {supplier} ON s_suppkey = first_supplier""",
    "ap_fields": """
        SELECT 'fld_' || k || '_' || i AS id, 'doc_' || k AS document_id, k, i,
          CASE i WHEN 1 THEN 'invoice_number' WHEN 2 THEN 'date' WHEN 3 THEN 'vendor_name' WHEN 4 THEN 'subtotal' WHEN 5 THEN 'tax' ELSE 'total_amount' END AS field_name,
          CASE i WHEN 1 THEN CASE WHEN k % 12 = 0 THEN 'X' || k ELSE 'INV-2025-' || substr(CAST(10000 + k % 10000 AS STRING), 2) END
            WHEN 2 THEN CAST(day AS STRING)
            WHEN 3 THEN CASE WHEN k % 29 = 0 THEN '' WHEN k % 25 = 0 THEN '  ' || vendor ELSE vendor END
            WHEN 4 THEN CAST(subtotal AS STRING) WHEN 5 THEN CAST(tax AS STRING)
            ELSE CASE WHEN k % 6 = 0 THEN '$' ELSE '' END || CASE WHEN k % 11 = 0 THEN CAST(CAST((subtotal + tax) * 10 AS DECIMAL(18,2)) AS STRING) ELSE CAST(CAST(subtotal + tax AS DECIMAL(18,2)) AS STRING) END END AS field_value,
          CASE WHEN (k + i) % 23 <> 0 THEN ((31 * k + 17 * i) % 61 + 40) / 100.0E0 END AS confidence,
          CASE WHEN (k + i) % 9 = 0 THEN 'invalid' WHEN (k + i) % 9 = 1 THEN 'corrected' ELSE 'valid' END AS status,
          CASE WHEN (k + i) % 9 = 0 THEN 'invalid value' END AS error_message, uploaded_at AS created_at
        FROM {ap_invoices} CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) n
        WHERE (7 * k + 3 * i) % 17 <> 0""",
    "ap_corrections": """
        SELECT 'cor_' || k || '_' || i || '_' || j AS id, document_id, id AS field_id, field_value || repeat('x', CAST(j AS INT)) AS original_value, field_value AS corrected_value,
          'usr_' || (k % 7) AS reviewed_by, created_at + j * INTERVAL '1' HOUR AS created_at
        FROM {ap_fields} CROSS JOIN (SELECT 1 AS j UNION ALL SELECT 2 UNION ALL SELECT 3) n
        WHERE (5 * k + 11 * i) % 13 = 0 AND j <= 1 + k % 3""",
    "ap_batches": """
        SELECT batch_id AS id, min(uploaded_by) AS created_by, min(uploaded_at) AS created_at, 'processing' AS status, count(*) AS total_documents
        FROM {ap_documents} WHERE batch_id IS NOT NULL GROUP BY batch_id""",
    "ap_receipts": """
        SELECT 'doc_' || k AS document_id, k,
          'ACME STORES' || chr(10) || CASE WHEN k % 5 <> 0 THEN 'Vendor: ' || vendor || chr(10) ELSE '' END || 'Invoice No: INV-2025-' || substr(CAST(10000 + k % 10000 AS STRING), 2) || chr(10)
          || CASE WHEN k % 7 <> 0 THEN 'Date: ' || CAST(day AS STRING) || chr(10) ELSE '' END || 'Subtotal: ' || CAST(subtotal AS STRING) || chr(10)
          || CASE WHEN k % 4 <> 0 THEN 'Tax: ' || CAST(tax AS STRING) || chr(10) ELSE '' END || 'Grand Total: $' || CAST(CAST(subtotal + tax AS DECIMAL(18,2)) AS STRING) AS text
        FROM {ap_invoices}""",
    "ap_blocks": """
        SELECT 'doc_' || k AS document_id, k, 1 AS page, CAST(2 * n + side AS INT) AS pos, 0.9E0 AS score,
          CASE WHEN side = 0 THEN CASE n WHEN 1 THEN 'Vendor:' WHEN 2 THEN 'Invoice No:' WHEN 3 THEN 'Date:' WHEN 4 THEN 'Subtotal' WHEN 5 THEN 'Tax' ELSE 'Grand Total' END
            ELSE CASE n WHEN 1 THEN vendor WHEN 2 THEN 'INV-' || k WHEN 3 THEN CAST(day AS STRING) WHEN 4 THEN CAST(subtotal AS STRING) WHEN 5 THEN CAST(tax AS STRING) ELSE '$' || CAST(CAST(subtotal + tax AS DECIMAL(18,2)) AS STRING) END END AS text,
          CASE WHEN side = 0 THEN 10.0E0 ELSE 200.0E0 END AS x1, 20.0E0 * n + k % 3 AS y1, CASE WHEN side = 0 THEN 110.0E0 ELSE 300.0E0 END AS x2, 20.0E0 * n + k % 3 + 12 AS y2
        FROM {ap_invoices} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) a CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) b
        WHERE side = 1 OR (k + n) % 9 <> 0""",
    "ap_replies": """
        SELECT 'doc_' || k AS document_id, k,
          CASE WHEN k % 31 = 0 THEN '' ELSE
            CASE WHEN k % 3 = 0 THEN '```json' || chr(10) ELSE 'Here it is: ' END
            || CASE WHEN k % 17 = 0 THEN '{{"invoice_number": "INV' ELSE
              '{{"invoice_number": "INV-' || k || '", "date": "' || CAST(day AS STRING) || '", "vendor_name": ' || CASE WHEN k % 13 = 0 THEN 'null' ELSE '"' || vendor || '"' END || ', "subtotal": "' || CAST(subtotal AS STRING) || '", "tax": "' || CAST(tax AS STRING) || '", "total_amount": "' || CAST(CAST(subtotal + tax AS DECIMAL(18,2)) AS STRING) || '"' || CASE WHEN k % 2 = 0 THEN ', "line_items": [{{"description": "a", "total": "1.00"}}, {{"description": "b"}}]' ELSE '' END || '}}' END
            || CASE WHEN k % 3 = 0 THEN chr(10) || '```' ELSE '' END END AS reply
        FROM {ap_invoices}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A ledger view over the sales tables in sf_dir, or one of these tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{t: view(spark, sf_dir, t) for t in _asked(name)})


def _asked(name: str) -> list[str]:
    return [t for t in (*TABLES, *VIEWS) if "{" + t + "}" in VIEWS[name]]


def view_sql(*names: str) -> str:
    """WITH clause that defines these views and what they rest on, for another engine's SQL."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in needed:
            for t in _asked(name):
                add(t)
            needed.append(name)

    for n in names:
        add(n)
    body = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n].format(**{t: t for t in (*TABLES, *VIEWS)})})" for n in needed)
    return f"WITH {body} " if body else ""


def text_pairs(spark: SparkSession, sf_dir: str, width: int = 80) -> DataFrame:
    """Text pairs (doc_id, pos, tier, field_name, reference, hypothesis) of all documents, whatever their characters.

    A text is cut after line breaks and every ``width`` characters: its references, in order of pos, are the whole
    text. Hypotheses are references that are cut, have a letter replaced or are empty; some are null.
    """
    text = F.col("text")
    parts = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(rf"([^\n]{{0,{width - 1}}}\n|[^\n]{{1,{width}}})"), F.lit(1)))
    cut = view(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(parts).alias("pos", "reference")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    k, r = F.coalesce("doc_id", F.lit(0)) + F.col("pos"), F.col("reference")
    of = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    at = lambda n: F.pmod(k, F.lit(n)) == 0
    tail = F.greatest(F.char_length(r) - 1 - F.pmod(k, F.lit(9)), F.lit(0)).cast("int")
    hypothesis = F.when(at(13), None).when(at(7), F.substring(r, F.lit(1), tail)).when(at(5), F.replace(r, F.lit("e"), F.lit("c"))).when(at(11), "").otherwise(r)
    return cut.select("doc_id", "pos", of(3, "local", "vlm", "unknown").alias("tier"), of(4, "vendor_name", "date", "total_amount", "invoice_number").alias("field_name"), "reference", hypothesis.alias("hypothesis"))


def sales_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger that the sales tables stand for: an order is a document, its lines are the items."""
    of = lambda name: view(spark, sf_dir, name)
    return Ledger(of("ap_documents").drop("k"), of("ap_fields").drop("k", "i"), of("ap_line_items"), of("ap_corrections"), of("ap_batches"))
