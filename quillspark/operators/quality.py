"""Extraction quality: error rates, match classes, latency, calibration, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import at_place, counted


def _safe(num, den):
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def align(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth rows (sample, field, value) with the prediction of the same, null if there is none."""
    return truth.withColumnRenamed("value", "truth").join(pred.withColumnRenamed("value", "pred"), ["sample", "field"], "left")


def corpus_cer(pairs: DataFrame, *keys: str) -> DataFrame:
    """Edits over reference length, summed first (micro average); all references empty: over hypothesis length."""
    r, h = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    n = F.sum(F.char_length(r))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(T.edits(r, h)) / F.when(n > 0, n).otherwise(F.greatest(F.sum(F.char_length(h)), F.lit(1))), 6).alias("cer"))


def _measured(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of each pair its edits and lengths in characters (e, n, m) and words (we, wn, wm) and its normalised CER (norm)."""
    r, h = F.coalesce("reference", F.lit("")), F.coalesce("hypothesis", F.lit(""))
    return pairs.select(*keys, T.edits(r, h).alias("e"), F.char_length(r).alias("n"), F.char_length(h).alias("m"), T.word_edits(F.col("reference"), F.col("hypothesis")).alias("we"), F.size(T.words(F.col("reference"))).alias("wn"), F.size(T.words(F.col("hypothesis"))).alias("wm"), T.normalized_cer(F.col("reference"), F.col("hypothesis")).alias("norm"))


def _rates() -> list[Column]:
    over = lambda n, m: F.when(F.sum(n) > 0, F.sum(n)).otherwise(F.greatest(F.sum(m), F.lit(1)))
    return [F.count("*").alias("n"), F.round(F.sum("e") / over("n", "m"), 6).alias("cer"), F.round(F.sum("we") / over("wn", "wm"), 6).alias("wer"), F.round(F.avg("norm"), 6).alias("norm_cer")]


def corpus_rates(pairs: DataFrame, *keys: str) -> DataFrame:
    """Number, micro-averaged CER and WER, and mean normalised CER; all references empty: over the hypotheses' length."""
    return _measured(pairs, *keys).groupBy(*keys).agg(*_rates())


def tier_verdict(pairs: DataFrame, a: str = "local", b: str = "vlm") -> DataFrame:
    """One row: both tiers' CER, their difference in points (positive: b is better) and what it means: beyond two points one is better."""
    rates = corpus_cer(pairs.where(F.col("tier").isin(a, b)), "tier")
    of = lambda t: F.max(F.when(F.col("tier") == t, F.col("cer")))
    df = rates.agg(of(a).alias("cer_a"), of(b).alias("cer_b")).where("cer_a is not null and cer_b is not null").withColumn("points", F.round((F.col("cer_a") - F.col("cer_b")) * 100, 4))
    return df.withColumn("verdict", F.when(F.col("points") > 2, "second is better").when(F.col("points") < -2, "second is worse").otherwise("similar"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """The rates of corpus_rates by tier and field, and by tier (field null)."""
    return _measured(pairs, "tier", "field_name").groupingSets([["tier", "field_name"], ["tier"]], "tier", "field_name").agg(*_rates())


def field_error_rates(pairs: DataFrame) -> DataFrame:
    rates = corpus_rates(pairs.where("reference is not null"), "field_name")
    return rates.withColumn("band", F.when(F.col("cer") < 0.02, "EXCELLENT").when(F.col("cer") < 0.10, "AVERAGE").otherwise("POOR"))


def tier_advantage(pairs: DataFrame, a: str = "local", b: str = "vlm") -> DataFrame:
    """CER difference of two tiers per field, in points (positive: b is better)."""
    rates = corpus_cer(pairs.where(F.col("tier").isin(a, b)), "tier", "field_name")
    of = lambda t, n: rates.where(F.col("tier") == t).select("field_name", F.col("cer").alias(n))
    return of(a, "cer_a").join(of(b, "cer_b"), "field_name").withColumn("points", F.round((F.col("cer_a") - F.col("cer_b")) * 100, 2))


def field_prf(aligned: DataFrame) -> DataFrame:
    """Match classes per field (field, pred, truth), with precision, recall and F1."""
    df = aligned.withColumn("bucket", T.match_class(F.col("pred"), F.col("truth"), F.col("field")))
    buckets = ("exact", "numeric_ok", "fuzzy", "wrong", "miss", "hallucination", "both_null")
    df = df.groupBy("field").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in buckets])
    tp = F.col("exact") + F.col("numeric_ok") + F.col("fuzzy")
    p, r = _safe(tp, tp + F.col("wrong") + F.col("hallucination")), _safe(tp, tp + F.col("miss") + F.col("wrong"))
    return df.withColumns({"precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(_safe(2 * p * r, p + r), 3)})


def field_verdicts(prf: DataFrame) -> DataFrame:
    top = F.greatest("miss", "wrong", "hallucination")
    worst = F.when(top == 0, None).when(F.col("miss") == top, "miss").when(F.col("wrong") == top, "wrong").otherwise("hallucination")
    return prf.select("field", "f1", F.when(F.col("f1") >= 0.8, "strong").when(F.col("f1") >= 0.5, "mid").otherwise("weak").alias("verdict"), worst.alias("dominant_failure"))


def exact_and_f1(aligned: DataFrame) -> DataFrame:
    df = aligned.where(F.coalesce("truth", F.lit("")) != "")
    same = F.col("pred").eqNullSafe(F.col("truth"))
    exact = F.when(same, 1).otherwise((T.norm_plain(F.coalesce("pred", F.lit(""))) == T.norm_plain(F.col("truth"))).cast("int"))
    return df.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(exact), 4).alias("exact"), F.round(F.avg(T.token_f1(F.col("pred"), F.col("truth"))), 4).alias("token_f1"))


def latency_profile(df: DataFrame, by: str, value: str) -> DataFrame:
    """Percentiles as the value at place round(p (n - 1)) of the sorted non-zero values, not interpolated."""
    upto = counted(df.where(F.col(value) > 0), value, by)
    at = lambda p: at_place(value, F.bround(F.lit(p) * (F.col("total") - 1), 0)).alias(f"p{round(p * 100)}")
    return upto.groupBy(by).agg(F.sum("n").alias("n"), F.min(value).alias("min"), *[at(p) for p in (0.5, 0.9, 0.95, 0.99)], F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 4).alias("mean"))


def parse_robustness(replies: DataFrame) -> DataFrame:
    reason = F.coalesce(T.parse_reply(F.col("reply"))["reason"], F.lit("ok"))
    return replies.groupBy(reason.alias("outcome")).agg(F.count("*").alias("replies"))


def line_item_match(df: DataFrame) -> DataFrame:
    """df (id, truth, pred: arrays of descriptions): over, under or equal count, and positions whose texts match (edits of 3 or less)."""
    t, p = F.size(F.coalesce("truth", F.array())), F.size(F.coalesce("pred", F.array()))
    good = lambda z: F.coalesce(F.levenshtein(T.norm_text(z["truth"]), T.norm_text(z["pred"])) <= 3, F.lit(False))
    zipped = F.slice(F.arrays_zip("truth", "pred"), 1, F.least(t, p))
    return df.select("id", F.when(p == t, "match").when(p > t, "over").otherwise("under").alias("count_match"), F.when(F.least(t, p) > 0, F.size(F.filter(zipped, good))).otherwise(0).alias("matched"), F.least(t, p).alias("compared"))


def field_coverage(truth: DataFrame) -> DataFrame:
    return truth.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.coalesce("value", F.lit("")) != "").alias("present"))


def worst_pairs(pairs: DataFrame, k: int, *ids: str) -> DataFrame:
    ranked = pairs.withColumn("cer", F.round(T.cer(F.col("reference"), F.col("hypothesis")), 6)).orderBy(F.desc("cer"), *ids).limit(k)
    return ranked.withColumn("ops", T.text_edit_ops(F.col("reference"), F.col("hypothesis")))


def failure_examples(aligned: DataFrame, n: int = 3) -> DataFrame:
    bad = aligned.withColumn("bucket", T.match_class(F.col("pred"), F.col("truth"), F.col("field"))).where(F.col("bucket").isin("wrong", "miss", "hallucination"))
    return bad.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy("sample"))).where(F.col("rank") <= n)


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability table of (p, label): equal bins with literal edges, the last one closed, and each bin's share of the error."""
    edge = F.lit(0)
    for i in range(1, bins):
        edge = edge + (F.col("p") >= i / bins).cast("int")
    total = F.sum("n").over(Window.partitionBy())  # bins rows
    table = scored.groupBy(edge.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("label").alias("share"))
    return table.withColumn("ece_part", F.round(F.col("n") / total * F.abs(F.col("mean_p") - F.col("share")), 8)).withColumns({c: F.round(c, 8) for c in ("mean_p", "share")})


def _cumulative(scored: DataFrame) -> DataFrame:
    """Per distinct score, from the top: rows and positives at it and so far. Scores meet by range partitions; only partitions' totals meet in one task."""
    counts = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    ranged = counts.repartitionByRange(F.desc("p")).withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("n").alias("pn"), F.sum("pos").alias("pp"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("bp"))
    w = Window.partitionBy("part").orderBy(F.desc("p"))
    return ranged.withColumns({"cn": F.sum("n").over(w), "cp": F.sum("pos").over(w)}).join(F.broadcast(totals), "part").select("p", "n", "pos", (F.col("cn") + F.col("bn")).alias("cn"), (F.col("cp") + F.col("bp")).alias("cp"))  # a row per partition


def best_threshold(scored: DataFrame) -> DataFrame:
    """The score with the best F1 when everything at or above it is positive; the lowest wins ties; (0.5, 0) for no rows."""
    total = scored.agg(F.sum("label").alias("all_pos"))
    f1 = F.coalesce(2 * F.col("cp") / F.nullif(F.col("cn") + F.col("all_pos"), F.lit(0)), F.lit(0.0))
    best = _cumulative(scored).crossJoin(F.broadcast(total)).withColumn("f1", F.round(f1, 10)).agg(F.max_by("p", F.struct("f1", -F.col("p"))).alias("threshold"), F.max("f1").alias("f1"))
    return best.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """AUROC (ties count a half) and average precision."""
    c = _cumulative(scored).crossJoin(F.broadcast(scored.agg(F.sum("label").alias("all_pos"), F.count("*").alias("all_n"))))
    neg = F.col("n") - F.col("pos")
    above = F.col("cp") - F.col("pos")
    out = c.agg(
        F.sum(neg * above + neg * F.col("pos") / 2).alias("wins"),
        F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("ap"),
        F.max("all_pos").alias("all_pos"),
        F.max("all_n").alias("all_n"),
    )
    return out.select(F.round(F.col("wins") / F.nullif(F.col("all_pos") * (F.col("all_n") - F.col("all_pos")), F.lit(0)), 8).alias("auroc"), F.round(F.col("ap") / F.nullif(F.col("all_pos"), F.lit(0)), 8).alias("auprc"))


def recall_by_operator(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where("label = 0").groupBy("operator").agg(F.count("*").alias("n"), F.round(F.avg((F.col("p") < threshold).cast("int")), 6).alias("recall"))


def threshold_prf(scored: DataFrame, threshold: float) -> DataFrame:
    """Flagged (below the threshold) against label 0 (bad): precision, recall, F1."""
    flag, bad = F.col("p") < threshold, F.col("label") == 0
    df = scored.where("p is not null").agg(F.count_if(flag & bad).alias("tp"), F.count_if(flag & ~bad).alias("fp"), F.count_if(~flag & bad).alias("fn"))
    p, r = _safe(F.col("tp"), F.col("tp") + F.col("fp")), _safe(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(_safe(2 * p * r, p + r), 6)})
