"""A training-data pipeline: toxicity, line dedup, near duplicates, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, jaccard, linededup, pieces, toxicity
from quillspark.llm.common import stored


def _columns(docs: DataFrame, text: str | None = None) -> DataFrame:
    """The columns of documents; with a new text, n_chars follows it."""
    if text:
        docs = docs.withColumn("text", F.col(text)).withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def _small_batches(spark: SparkSession) -> None:
    """Python workers get at most 1,000 whole texts at once: the usual 10,000 take hundreds of megabytes in executors. Stages run after they return, so the session keeps this."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(1000, int(spark.conf.get(rows))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.3 or more) go."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    return _columns(toxicity.score(docs, model, out="toxicity").where("toxicity < 0.3"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in one of them. Documents all stay, even without lines."""
    kept = linededup.dedup_lines(docs, min_chars=20, min_docs=3, keep=("lang", "source"))
    return _columns(kept, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays, and of rows alike in id and text one.

    Null ids are larger than others and of rows without an id the one of the least text hash stays. Texts without words are linked with nothing.
    """
    found = jaccard.jaccard_components(docs, words=5, share=80)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_tag") == F.col("component_tag"))).select(F.col("doc_id").alias("kept_id"), F.col("row_tag").alias("kept_tag")).distinct()
    tagged = docs.withColumn("row_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = tagged.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_tag") == F.col("kept_tag")), "left_semi").dropDuplicates(["doc_id", "row_tag"])
    return _columns(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words is in 13-word windows of the benchmark go."""
    _small_batches(spark)
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("text", "lang", "source", "n_chars"))
    return _columns(found.where("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text's best segmentation, and the scores of its four best."""
    import public_tokenizers

    _small_batches(spark)
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), n=4)
    return found.select("doc_id", "n_tokens", "score", F.transform("nbest", lambda x: x["score"]).alias("nbest_scores"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: A trained classifier and piece lattices aren't SQL; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
