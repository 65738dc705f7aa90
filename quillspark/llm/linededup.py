"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stored, text_of

#: A key with over so small a share of all counted documents is heavy: there are at most so many such keys.
HEAVY_KEYS = 10_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that many documents share, except in the largest id that holds them.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points in at least ``min_docs`` distinct ids loses all its lines but those of the
    largest such id. Returns one row per input row: the id, ``n_lines``, ``n_dropped``, ``kept_text``
    and the columns to ``keep``.

    Null or empty text: one empty line. Rows with the same id count once, and each is cleaned; equal rows
    get equal results. A null id adds nothing to a key's count, and keys that are dropped elsewhere are
    dropped in it. Keys are compared by 128 bits of hash. A key in a third of the documents costs no task
    more than others: counts are combined before the shuffle, and on the way back lines of heavy keys (at most HEAVY_KEYS, so
    they can be broadcast) get their keeper where they are and are dealt at random in the join of the others.
    """
    held = F.struct(F.lit(0).alias("_"), *keep).alias("held")
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), held).withColumn("row_hash", F.xxhash64("text"))
    lines = (
        base.select("id", "row_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    shared = lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    shared = stored(shared, "line-keys")
    share = (shared.agg(F.sum("n")).first()[0] or 0) / HEAVY_KEYS
    heavy, light = shared.where(F.col("n") > share).select("h1", "h2", F.col("keeper").alias("heavy_keeper"), F.lit(True).alias("heavy")), shared.where(F.col("n") <= share).drop("n")
    # A heavy line's own hash in place of its key's: no light key needs to match it.
    marked = lines.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("h1", F.when(F.col("heavy"), F.xxhash64("id", "row_hash", "pos")).otherwise(F.col("h1")))
    drops = (
        marked.join(light, ["h1", "h2"], "left")
        .withColumn("keeper", F.when(F.col("heavy"), F.col("heavy_keeper")).otherwise(F.col("keeper")))
        .where(F.col("heavy") | F.col("keeper").isNotNull())
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row_hash")
        .agg(F.collect_set("pos").alias("drop_pos"))
        .select(F.col("id").alias("drop_id"), F.col("row_hash").alias("drop_hash"), "drop_pos")
    )
    split = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("drop_pos")), lambda p: F.get(F.col("lines"), p))
    return (
        base.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("row_hash") == F.col("drop_hash")), "left")
        .withColumn("lines", split)
        .select(
            F.col("id").alias(id_col),
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("drop_pos"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("drop_pos").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
            *[F.col("held")[c].alias(c) for c in keep],
        )
    )
