"""Forecasts per series, anomalies, calibrated thresholds, insights."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.shared import stored
from .ranks import counted, percentile


def _ordered(series: DataFrame, *keys: str) -> DataFrame:
    """series (month yyyy-MM, value) with the month's place in its series."""
    return series.withColumn("x", (F.row_number().over(Window.partitionBy(*keys).orderBy("month")) - 1).cast("double"))


def _ahead(fitted: DataFrame, h: int, value) -> DataFrame:
    """Rows for the h months after the last one."""
    df = fitted.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    month = F.date_format(F.add_months(F.to_date(F.concat("last_month", F.lit("-01"))), F.col("k")), "yyyy-MM")
    return df.withColumn("month", month).withColumn("forecast", F.round(F.greatest(value, F.lit(0.0)), 2))


def forecast_linear(series: DataFrame, h: int = 3, *keys: str) -> DataFrame:
    """Least squares on the month's place, 0 at least; a single month repeats itself."""
    fit = _ordered(series, *keys).groupBy(*keys).agg(F.regr_slope("value", "x").alias("b"), F.regr_intercept("value", "x").alias("a"), F.max("x").alias("n"), F.max("month").alias("last_month"), F.max_by("value", "month").alias("last"))
    value = F.when(F.col("n") == 0, F.col("last")).otherwise(F.coalesce(F.col("a") + F.col("b") * (F.col("n") + F.col("k")), F.col("last")))
    return _ahead(fit.where("last_month is not null"), h, value).select(*keys, "month", "forecast")


def forecast_ar(series: DataFrame, h: int = 3, *keys: str, grid: int = 400) -> DataFrame:
    """ARIMA(1,1,0) by exact likelihood of the differences, where there are six months; else least squares.

    The likelihood needs three sums of a series only, so all series are fitted as columns: phi by a grid
    over (-1, 1), then a finer one around the best.
    """
    w = Window.partitionBy(*keys).orderBy("month")
    d = _ordered(series, *keys).withColumn("d", F.col("value") - F.lag("value").over(w)).withColumn("d1", F.lag("d").over(w)).withColumn("next", F.lead("d").over(w))
    inner = F.when(F.col("d1").isNotNull() & F.col("next").isNotNull(), F.col("d") * F.col("d"))
    s = d.groupBy(*keys).agg(F.count("*").alias("months"), F.count("d").alias("n"), F.sum(F.col("d") * F.col("d")).alias("s1"), F.sum(F.col("d") * F.col("d1")).alias("s2"), F.sum(inner).alias("s3"), F.max("month").alias("last_month"), F.max_by("value", "month").alias("last"), F.max_by("d", "month").alias("last_d"))
    s = s.where((F.col("months") >= 6) & (F.col("s1") > 0))

    def ll(p):
        q = F.col("s1") - 2 * p * F.col("s2") + p * p * F.coalesce("s3", F.lit(0.0))
        return -F.col("n") / 2 * F.log(q / F.col("n")) + 0.5 * F.log(1 - p * p)

    def best(points):
        return F.element_at(F.array_sort(F.transform(points, lambda p: F.struct((-ll(p)).alias("l"), p.alias("p")))), 1)["p"]

    coarse = F.transform(F.sequence(F.lit(1), F.lit(grid - 1)), lambda i: i * (2.0 / grid) - 1)
    s = s.withColumn("phi", best(coarse))
    fine = F.transform(F.sequence(F.lit(-50), F.lit(50)), lambda i: F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.col("phi") + i * (2.0 / grid / 50))))
    s = s.withColumn("phi", best(fine))
    geometric = F.col("phi") * (1 - F.pow(F.col("phi"), F.col("k"))) / (1 - F.col("phi"))
    ar = _ahead(s, h, F.col("last") + F.col("last_d") * geometric).select(*keys, "month", "forecast", F.lit("ar").alias("method"))
    lin = forecast_linear(series, h, *keys).withColumn("method", F.lit("linear"))
    if keys:
        rest = lin.join(s.select(*keys), list(keys), "left_anti")
    else:
        rest = lin.crossJoin(F.broadcast(s.agg(F.count("*").alias("fitted")))).where("fitted = 0").drop("fitted")  # one row
    return ar.unionByName(rest)


def anomalies(stats: DataFrame) -> DataFrame:
    """stats (document_id, amount, avg_confidence, n_corrections): documents more than two deviations off, or corrected over three times."""
    base = stats.select("document_id", F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("avg_confidence", F.lit(0.0)).alias("conf"), "n_corrections")
    m = base.agg(*[f(c).alias(f"{n}_{c}") for c in ("amount", "conf") for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("docs"))
    df = base.crossJoin(F.broadcast(m)).where("docs >= 2")  # one row
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(F.abs(z("amount")) > 2, "unusual_amount"), F.when(F.abs(z("conf")) > 2, "unusual_confidence"), F.when(F.col("n_corrections") > 3, "many_corrections")))
    return df.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("document_id", "reasons", F.round(F.size("reasons") / 3, 4).alias("score"))


def _grow(rows: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> list:
    """An isolation tree: [column, cut, low, high] or the leaf's path length beyond its depth."""
    n = len(rows)
    spread = rows.max(axis=0) - rows.min(axis=0) if n else np.zeros(0)
    if depth >= most or n <= 1 or not (spread > 0).any():
        return [depth + (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2))]
    col = int(rng.choice(np.flatnonzero(spread > 0)))
    cut = float(rng.uniform(rows[:, col].min(), rows[:, col].max()))
    low = rows[:, col] < cut
    return [col, cut, _grow(rows[low], rng, depth + 1, most), _grow(rows[~low], rng, depth + 1, most)]


def _lengths(tree: list, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    out = np.empty(len(rows))
    low = rows[:, tree[0]] < tree[1]
    out[low], out[~low] = _lengths(tree[2], rows[low]), _lengths(tree[3], rows[~low])
    return out


def isolation_forest(stats: DataFrame, trees: int = 100, sample: int = 256, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The share of documents with the shortest mean paths in isolation trees; each tree grows on its own hash sample in its own task.

    A document's score is how far its path score is above the cut, the exact percentile at which the share begins.
    """
    import json

    cols = ["amount", "avg_confidence", "n_corrections"]
    base = stored(stats.select("document_id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in cols]), "stats")
    n = base.count()
    if n < 10:
        return base.select("document_id", F.lit(0.0).alias("score")).limit(0)
    rate = min(1.0, 2 * sample * trees / n)
    picked = base.withColumn("u", F.pmod(F.xxhash64("document_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).where(F.col("u") < rate)
    picked = picked.withColumn("tree", F.floor(F.col("u") / rate * trees).cast("int")) if n > sample * trees else base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).where(F.pmod(F.xxhash64("document_id", "tree", F.lit(seed)), F.lit(n)) < 2 * sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iat[0])
        rows = pdf.sort_values("document_id")[cols].to_numpy()
        rng = np.random.default_rng([seed, t])
        rows = rows[rng.permutation(len(rows))[:sample]]
        return pd.DataFrame({"tree": [t], "model": [json.dumps(_grow(rows, rng, 0, int(np.ceil(np.log2(max(2, len(rows)))))))]})

    forest = [json.loads(r[0]) for r in picked.groupBy("tree").applyInPandas(grow, "tree int, model string").select("model").collect()]
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # trees times sample nodes
    norm = 2 * (np.log(min(sample, n) - 1) + 0.5772156649) - 2 * (min(sample, n) - 1) / min(sample, n)

    def lengths(batches):
        for pdf in batches:
            rows = pdf[cols].to_numpy()
            mean = np.mean([_lengths(t, rows) for t in shared.value], axis=0) if len(rows) else np.zeros(0)
            yield pdf.assign(score=np.power(2.0, -mean / norm))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    scored = stored(base.mapInPandas(lengths, kinds + ", score double"), "isolation-scores")
    cut = counted(scored, "score").agg(percentile("score", 1 - share)).first()[0]
    m = base.agg(*[f(c).alias(f"{k}_{c}") for c in cols[:2] for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: F.abs((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))) > 1.5
    reasons = F.array_compact(F.array(F.when(z("amount"), "unusual_amount"), F.when(z("avg_confidence"), "unusual_confidence"), F.when(F.col("n_corrections") > 2, "many_corrections")))
    out = scored.where(F.col("score") > cut).crossJoin(F.broadcast(m)).withColumn("reasons", reasons)  # one row
    return out.select("document_id", F.round(F.col("score") - cut, 4).alias("score"), F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("isolated"))).alias("reasons"))


#: Distinct counts that the passes of a fit read on the driver, at most; more are summed by a job a pass.
FEW_COUNTS = 1 << 16


def calibrate(ap: Ledger, passes: int = 25) -> DataFrame:
    """Confidence threshold per field name, from which fields were corrected.

    Under 5 samples none; under 10 mean less sample deviation of the corrected ones' confidence (.80 for none);
    else the logistic fit's crossing -b/w, clamped to .5-.99, or the former where the fit says nothing.
    Newton steps run on one small table of distinct (field, confidence, label) counts, all fields at once.
    """
    hit = ap.corrections.select(F.col("field_id").alias("id")).distinct().withColumn("y", F.lit(1))
    rows = ap.fields.where("confidence is not null").join(hit, "id", "left").select("field_name", F.col("confidence").alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return fit_counts(rows.groupBy("field_name", "x", "y").agg(F.count("*").alias("n")), passes)


def fit_counts(table: DataFrame, passes: int = 25) -> DataFrame:
    """calibrate's thresholds from counts (field_name, x, y, n) of confidences x that weren't (0) or were (1) corrected."""
    table = table.cache()
    few = table.limit(FEW_COUNTS + 1).count() <= FEW_COUNTS
    n, ny = F.sum("n"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    bad = F.when(F.col("y") == 1, F.col("x"))
    mean = F.sum(bad * F.col("n")) / ny
    dev = F.sqrt((F.sum(bad * bad * F.col("n")) - ny * mean * mean) / F.nullif(ny - 1, F.lit(0)))
    base = table.groupBy("field_name").agg(n.alias("samples"), ny.alias("corrected"), F.when(ny > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - F.coalesce(dev, F.lit(0.0))))).otherwise(0.80).alias("heuristic"))
    spark, kinds = table.sparkSession, base.schema
    base = spark.createDataFrame(base.collect(), kinds)  # a row for each field name
    w = {r[0]: (0.0, 0.0) for r in base.select("field_name").collect()}
    slopes = _slopes_here(table) if few else functools.partial(_slopes, table)
    for _ in range(passes if w else 0):
        step = 0.0
        for name, (gw, gb, hw, hx, hb) in slopes(w).items():
            at = w[name]
            gw, hw = gw + at[0], hw + 1  # L2 on the weight, not on the intercept
            det = hw * hb - hx * hx
            dw, db = ((hb * gw - hx * gb) / det, (hw * gb - hx * gw) / det) if det > 1e-12 else (0.0, 0.0)
            w[name] = (at[0] - dw, at[1] - db)
            step = max(step, abs(dw), abs(db))
        if step < 1e-9:
            break
    table.unpersist()
    fitted = spark.createDataFrame([(k, *v) for k, v in w.items()], "field_name string, w double, b double")
    df = base.join(F.broadcast(fitted), "field_name")
    line = F.when((F.col("corrected") > 0) & (F.col("corrected") < F.col("samples")) & (F.abs("w") >= 1e-6), F.greatest(F.lit(0.5), F.least(F.lit(0.99), -F.col("b") / F.col("w"))))
    threshold = F.when(F.col("samples") < 5, None).when(F.col("samples") < 10, F.col("heuristic")).otherwise(F.coalesce(line, "heuristic"))
    return df.select("field_name", "samples", "corrected", F.round("heuristic", 6).alias("heuristic"), F.round(threshold, 6).alias("threshold"))


def _slopes(table: DataFrame, w: dict[str, tuple[float, float]]) -> dict[str, tuple[float, ...]]:
    """Of each field name the first and second derivatives of the loss at its weight and intercept, by a job."""
    now = table.sparkSession.createDataFrame([(k, *v) for k, v in w.items()], "field_name string, w double, b double")
    p = 1 / (1 + F.exp(-(F.col("w") * F.col("x") + F.col("b"))))
    q = F.col("n") * p * (1 - p)
    g = F.col("n") * (p - F.col("y"))
    sums = table.join(F.broadcast(now), "field_name").groupBy("field_name").agg(F.sum(g * F.col("x")), F.sum(g), F.sum(q * F.col("x") * F.col("x")), F.sum(q * F.col("x")), F.sum(q))
    return {r[0]: tuple(r)[1:] for r in sums.collect()}


def _slopes_here(table: DataFrame) -> Callable[[dict], dict]:
    """The same, from counts that are few."""
    rows = {name: g[["x", "y", "n"]].to_numpy(float).T for name, g in table.toPandas().groupby("field_name")}

    def slopes(w: dict[str, tuple[float, float]]) -> dict[str, tuple[float, ...]]:
        out = {}
        for name, (x, y, n) in rows.items():
            p = 1 / (1 + np.exp(-(w[name][0] * x + w[name][1])))
            q, g = n * p * (1 - p), n * (p - y)
            out[name] = tuple(float(v.sum()) for v in (g * x, g, q * x * x, q * x, q))
        return out

    return slopes


def insights(risk: DataFrame, history: DataFrame, forecast: DataFrame, n_anomalies: DataFrame) -> DataFrame:
    """Sentences on high-risk suppliers (by name), the last forecast month more than a fifth off the last known one, and anomalies; or
    that there is nothing. Without a known month a forecast above nothing is a rise; without a forecast nothing is said of spend."""
    high = risk.agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("risk_score") >= 60, F.col("supplier_name")))), ", ").alias("high"))
    last = history.agg(F.coalesce(F.max_by("value", "month"), F.lit(0.0)).alias("last"))
    nxt = forecast.agg(F.max_by("forecast", "month").alias("next"))
    df = high.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(nxt)).crossJoin(F.broadcast(n_anomalies.agg(F.count("*").alias("odd"))))  # one row each
    # The sentences.
    text = F.array_compact(
        F.array(
            F.when(F.col("high") != "", F.format_string("High-risk suppliers detected: %s. Consider additional review.", "high")),
            F.when(F.col("next") > F.col("last") * 1.2, "Spend is projected to increase significantly. Review budget allocations.").when(F.col("next") < F.col("last") * 0.8, "Spend is projected to decrease. Verify supplier activity."),
            F.when(F.col("odd") > 0, F.format_string("%d anomalous document(s) detected. Review flagged documents for potential issues.", "odd")),
        )
    )
    return df.select(F.explode(F.when(F.size(text) > 0, text).otherwise(F.array(F.lit("No significant concerns detected. All metrics within normal range.")))).alias("insight"))
