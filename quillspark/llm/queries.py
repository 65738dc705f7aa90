"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hardneg, jaccard, katz, kmtree, linededup, pieces, secrets, tokenbin, topk, toxicity, trie, warc
from .common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.RULES[:3]]
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s["rank"] < len(base))
    return found.select("doc_id", *counts, F.sha2(secrets.joined(own), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, payloads = warc.content_addressed(_table(spark, sf_dir, "pages"))
    found = stored(warc.read_warc(spark, warc.write_warc(spark, records, payloads), payload=False).drop("header", "payload"), "warc-index")
    if not warc.revisits_agree(found):
        raise ValueError("a revisit and its response differ in payload")
    page = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)
    return found.select("doc_id", "n_tokens", "score", F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"), "ids_crc32", "text_back")


def _remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels.where(_remainder(4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenbin.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenbin.document_index(spark, path)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("conv_id")
    turns = trie.with_borrowed_heads(trie.numbered_turns(_table(spark, sf_dir, "conversations")), own - own % 100, F.crc32(own.cast("string")) % 6, 5, own % 100 == 0)
    return trie.prefix_trie(turns)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.ann(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict:
    return {f.__name__: f for f in (op1_katz_backoff, op2_ngram_jaccard_join, op3_exact_top_k, op4_benchmark_decontamination, op5_secret_scan, op6_warc, op7_sentencepiece, op8_toxicity, op9_token_binary, op10_line_dedup, op11_prefix_trie, op12_hard_negatives, op13_nearest_neighbours)}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.vec_id % 100 = 0))
WHERE rank <= 10"""

_OP11 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, turn, length(text) AS chars, sha256(strlen(role) || ':' || role || text)[:32] AS id FROM c),
own AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(chars ORDER BY turn NULLS FIRST, id) AS chars FROM t GROUP BY conv_id),
h AS (SELECT *, CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS INTEGER) AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ids, [])[:h], h.ids[h + 1:]) AS ids, list_concat(coalesce(b.chars, [])[:h], h.chars[h + 1:]) AS chars FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, ids[:d] AS k, d = len(ids) AS ended, coalesce(chars[d], 0) AS last FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(last) AS last, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM m GROUP BY d, k),
ch AS (SELECT d - 1 AS d, k[:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, k)),
s AS (SELECT len(p) AS d, p AS k, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * last) AS BIGINT) AS saved_tokens FROM (SELECT *, k[:unnest(range(d + 1))] AS p FROM f) GROUP BY p)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (d, k) LEFT JOIN n p ON p.d = f.d - 1 AND p.k = f.k[:f.d - 1]"""

_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS vec_id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""

_OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS l, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wins))),
hits AS (SELECT doc_id, i, l, item FROM places JOIN wins USING (l, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages),
v AS (SELECT *, list_transform(range(8), lambda c: list_sum(list_transform(range(5), lambda k: (strpos('0123456789abcdef', substr(h, CAST(5 * c + k + 1 AS INT), 1)) - 1) * CAST(pow(16, 4 - k) AS BIGINT)))) AS chunks FROM p)
SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(chunks[j // 4 + 1] AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM v"""

_OP10 = f"""
WITH k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS key FROM
  (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN shared USING (key) GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the query on whole tables; the others are tested against brute force."""
    return {"op3_exact_top_k": _OP3, "op4_benchmark_decontamination": _OP4, "op6_warc": _OP6, "op10_line_dedup": _OP10, "op11_prefix_trie": _OP11, "op12_hard_negatives": _OP12}
