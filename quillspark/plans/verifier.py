"""The plausibility verifier: features, corruptions, labelled sets, training, calibration and batch scoring."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import _let, parse_amount, parse_date_any
from ..operators.documents import upsert
from ..operators.quality import best_threshold, ece, ranking_metrics, recall_by_operator
from ..operators.stats import supplier_risk
from ..sources.ledger import FIELDS
from ..sources.shared import stored
from .boosting import Boosted, boosted

#: The features, in order.
FEATURES = (
    "math_residual_relative", "math_residual_absolute", "line_items_sum_residual", "line_items_arithmetic_failrate", "line_items_arithmetic_max_dev",
    "log_total", "log_subtotal", "log_tax", "ratio_max_lineitem_to_total", "ratio_min_lineitem_to_total", "tax_to_subtotal_ratio",
    "decimal_places_total", "decimal_places_subtotal", "decimal_places_tax",
    "n_line_items", "has_invoice_number", "has_date", "has_vendor_name", "has_subtotal", "has_tax", "has_total", "all_line_items_have_total", "all_line_items_have_quantity_and_price",
    "vendor_name_length", "vendor_name_has_digits", "vendor_name_uppercase_ratio", "vendor_name_has_punct", "invoice_number_length", "invoice_number_alnum_ratio", "date_parses", "date_within_5_years",
    "ocr_confidence", "ocr_confidence_below_85",
    "currency_marker_consistent", "currency_marker_count_distinct", "negative_amount_present", "all_amounts_round", "tax_sign_negative",
)
SCHEMA_HASH = hashlib.sha256("|".join(FEATURES).encode()).hexdigest()[:16]
_MARKER = r"((?i)rs\.?|pkr|inr|usd|\$|€|£)"


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _share(text: Column, keep: str) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, F.char_length(F.regexp_replace(text, f"[^{keep}]", "")) / n).otherwise(0.0)


def features(wide: DataFrame, today: str, confidence: str | None = None) -> DataFrame:
    """wide (document_id, six texts, items) with the 38 features. Amounts are exact until they become features."""
    num = wide.withColumns({f"_{c}": parse_amount(F.col(c)) for c in ("total_amount", "subtotal", "tax")})
    num = num.withColumn("items", F.coalesce("items", F.expr("array()").cast(wide.schema["items"].dataType)))
    exact = lambda x, c: parse_amount(x[c])
    num = num.withColumn("_items", F.transform("items", lambda x: F.struct(exact(x, "quantity").alias("q"), exact(x, "unit_price").alias("p"), exact(x, "total").alias("t"))))
    dbl = lambda c: F.col(c).cast("double")
    total, sub, tax = dbl("_total_amount"), dbl("_subtotal"), dbl("_tax")
    residual = F.when(total.isNotNull() & sub.isNotNull() & tax.isNotNull(), F.abs(F.col("_subtotal") + F.col("_tax") - F.col("_total_amount")).cast("double")).otherwise(0.0)
    items_sum = F.aggregate("_items", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + F.coalesce(x["t"], F.lit(0))).cast("decimal(38,6)"))
    dev = lambda x: (
        F.when((F.abs(x["t"]) < 0.01) & (x["t"] == 0) & (x["q"] * x["p"] == 0), 0.0)
        .when(F.abs(x["t"]) < 0.01, F.when(F.abs(x["q"] * x["p"]) >= 0.01, F.abs(x["q"] * x["p"]).cast("double")).otherwise(0.0))
        .otherwise(F.abs((x["q"] * x["p"] - x["t"]).cast("double") / x["t"].cast("double")))
    )
    num = num.withColumn("_devs", F.transform(F.filter("_items", lambda x: x["q"].isNotNull() & x["p"].isNotNull() & x["t"].isNotNull()), dev))
    num = num.withColumn("_sizes", F.filter(F.transform("_items", lambda x: F.abs(x["t"].cast("double"))), lambda v: v > 0))
    log = lambda v: F.when(F.abs(v) > 1e-9, F.log10(F.abs(v))).otherwise(0.0)
    ratio = lambda f: F.when((F.size("_sizes") > 0) & (F.abs(total) > 1e-9), f("_sizes") / F.abs(total)).otherwise(0.0)
    places = lambda c: F.when(F.instr(F.coalesce(c, F.lit("")), ".") > 0, F.char_length(F.regexp_extract(c, r"\.(.*)$", 1))).otherwise(0).cast("double")
    has = lambda c: _flag(F.coalesce(c, F.lit("")) != "")
    n = F.size("items")
    vendor, number = F.coalesce("vendor_name", F.lit("")), F.coalesce("invoice_number", F.lit(""))
    day = parse_date_any(F.col("date"))
    conf = F.coalesce(F.col(confidence) if confidence else F.lit(None).cast("double"), F.lit(0.0))
    raws = F.concat(F.array("subtotal", "tax", "total_amount"), F.transform("items", lambda x: x["unit_price"]), F.transform("items", lambda x: x["total"]))
    marks = F.array_distinct(F.transform(F.flatten(F.transform(raws, lambda r: F.regexp_extract_all(F.coalesce(r, F.lit("")), F.lit(_MARKER), F.lit(1)))), lambda m: F.rtrim(F.lower(m), F.lit("."))))
    known = F.filter(F.array("_subtotal", "_tax", "_total_amount"), lambda v: v.isNotNull())
    present = lambda x, c: F.coalesce(x[c], F.lit("")) != ""
    values = {
        "math_residual_relative": residual / F.greatest(F.abs(F.coalesce(total, F.lit(0.0))), F.lit(1.0)), "math_residual_absolute": residual,
        "line_items_sum_residual": F.when(F.coalesce(sub, F.lit(0.0)) != 0, F.abs(items_sum - F.col("_subtotal")).cast("double") / F.greatest(F.abs(sub), F.lit(1.0))).otherwise(0.0),
        "line_items_arithmetic_failrate": F.when(F.size("_devs") > 0, F.size(F.filter("_devs", lambda v: v > 0.01)) / F.size("_devs")).otherwise(0.0),
        "line_items_arithmetic_max_dev": F.coalesce(F.array_max("_devs"), F.lit(0.0)),
        "log_total": log(total), "log_subtotal": log(sub), "log_tax": log(tax),
        "ratio_max_lineitem_to_total": ratio(F.array_max), "ratio_min_lineitem_to_total": ratio(F.array_min),
        "tax_to_subtotal_ratio": F.when((F.abs(sub) > 1e-9) & tax.isNotNull(), tax / sub).otherwise(0.0),
        "decimal_places_total": places(F.col("total_amount")), "decimal_places_subtotal": places(F.col("subtotal")), "decimal_places_tax": places(F.col("tax")),
        "n_line_items": n.cast("double"), **{f"has_{a}": has(F.col(b)) for a, b in (("invoice_number", "invoice_number"), ("date", "date"), ("vendor_name", "vendor_name"), ("subtotal", "subtotal"), ("tax", "tax"), ("total", "total_amount"))},
        "all_line_items_have_total": _flag((n > 0) & F.forall("items", lambda x: present(x, "total"))),
        "all_line_items_have_quantity_and_price": _flag((n > 0) & F.forall("items", lambda x: present(x, "quantity") & present(x, "unit_price"))),
        "vendor_name_length": F.char_length(vendor).cast("double"), "vendor_name_has_digits": _flag(vendor.rlike(r"\p{Nd}")), "vendor_name_uppercase_ratio": _share(vendor, r"\p{Lu}"),
        "vendor_name_has_punct": _flag(vendor.rlike(r"(?U)[^\w\s]")), "invoice_number_length": F.char_length(number).cast("double"), "invoice_number_alnum_ratio": _share(number, r"\p{L}\p{N}"),
        "date_parses": _flag(day.isNotNull()), "date_within_5_years": _flag(F.abs(F.datediff(F.lit(today).cast("date"), day)) <= 5 * 366),
        "ocr_confidence": conf.cast("double"), "ocr_confidence_below_85": _flag(conf < 0.85),
        "currency_marker_consistent": _flag(F.size(marks) <= 1), "currency_marker_count_distinct": F.size(marks).cast("double"),
        "negative_amount_present": _flag(F.exists(known, lambda v: v < 0) | F.exists("_items", lambda x: F.coalesce(x["t"] < 0, F.lit(False)))),
        "all_amounts_round": _flag((F.size(known) > 0) & F.forall(known, lambda v: v == F.floor(v))), "tax_sign_negative": _flag(tax < 0),
    }
    return num.select(*wide.columns, *[values[f].cast("double").alias(f) for f in FEATURES])


#: Texts that scanners take for one another, in both directions.
CONFUSED = (("0", "O"), ("1", "l"), ("1", "I"), ("5", "S"), ("8", "B"), ("6", "G"), ("2", "Z"), ("rn", "m"))
#: Factors of slips and skews, foreign marks, and how many operators are tried on a row.
SLIPS, SKEWS, MARKS, TRIED = ("10", "100", "0.1", "0.01"), ("2", "0.5", "3"), ("$", "€", "£"), 8
AMOUNTS = ("subtotal", "tax", "total_amount")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _corruptions(df: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, list[tuple[str, Column, Column]]]]:
    """df (with a hash _u that decides all choices) with helper columns, in layers so that nothing is written out twice; of each operator
    what it makes (operator, text, items), null where it doesn't apply; and of the text columns which operators change them, when, and to what."""
    u, c = F.col("_u"), F.col
    pick = lambda n, salt: F.pmod(F.xxhash64(u, F.lit(salt)), F.greatest(n if isinstance(n, Column) else F.lit(n), F.lit(1))).cast("int")
    one_of = lambda values, salt: F.get(F.array(*map(F.lit, values)), pick(len(values), salt))
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    plain = lambda x: F.regexp_replace(x, r"[^0-9.\-]", "")
    two = lambda v: F.bround(v, 2).cast("decimal(38,2)").cast("string")
    digits = lambda raw: F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(raw), F.lit(1))), lambda i: F.substring(raw, i, F.lit(1)).rlike(r"\d"))
    value = lambda name, cs: F.coalesce(*[F.when(name == x, c(x)) for x in cs])
    seen = (*AMOUNTS, "vendor_name", "invoice_number")
    names = lambda cs: F.array_compact(F.array(*[F.when(filled(c(x)), F.lit(x)) for x in cs]))
    items, vendor, tax = c("items"), c("vendor_name"), c("tax")

    df = df.withColumns({"_some": names(AMOUNTS), "_seen": names(seen), "_day": F.trim("date")})
    n = F.size("_some")
    of = {"_slip": 1, "_drop": 3, "_put": 5, "_mark": 20}
    df = df.withColumns(
        {
            **{f"{k}_of": F.get("_some", pick(n, salt)) for k, salt in of.items()},
            "_mix_of": F.get("_seen", pick(F.size("_seen"), 10)),
            "_first": pick(n, 8),
            "_ratio": one_of(SLIPS, 2),
            "_mark": one_of(MARKS, 21),
            "_able": F.filter(F.transform(items, lambda x, i: F.when((filled(x["quantity"]) | filled(x["unit_price"])) & filled(x["total"]), i)), lambda i: i.isNotNull()),
        }
    )
    df = df.withColumns(
        {
            **{f"{k}_raw": value(c(f"{k}_of"), AMOUNTS) for k in of},
            "_mix_raw": value(c("_mix_of"), seen),
            "_x": F.get("_some", c("_first")),
            "_y": F.get("_some", F.pmod(c("_first") + 1 + pick(n - 1, 9), F.greatest(n, F.lit(1))).cast("int")),
            "_skew_at": F.get("_able", pick(F.size("_able"), 17)),
        }
    )
    df = df.withColumns({"_item": F.get(items, c("_skew_at")), "_x_value": value(c("_x"), AMOUNTS), "_y_value": value(c("_y"), AMOUNTS)})
    item = c("_item")
    df = df.withColumn("_by_quantity", F.when(pick(2, 18) == 0, filled(item["quantity"])).otherwise(~filled(item["unit_price"])))
    df = df.withColumn("_skew_raw", F.when(c("_by_quantity"), item["quantity"]).otherwise(item["unit_price"]))
    once = lambda raw, x, y: F.overlay(raw, F.lit(y), F.instr(raw, F.lit(x)), F.lit(len(x)))
    mix = c("_mix_raw")
    swaps = [F.struct(F.xxhash64(u, F.lit(x), F.lit(y)).alias("h"), F.when(F.contains(mix, F.lit(x)), once(mix, x, y)).when(F.contains(mix, F.lit(y)), once(mix, y, x)).alias("new")) for x, y in CONFUSED]
    n_edits = 1 + pick(F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.char_length(vendor) / 4).cast("int"))), 11)

    def edit(text: Column, i: Column) -> Column:
        roll = lambda n, salt: F.pmod(F.xxhash64(u, i, F.lit(salt)), F.greatest(n, F.lit(1))).cast("int")
        kind, at = roll(F.lit(3), 12), roll(F.char_length(text), 13) + 1
        head, rest, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.char_length(text)), F.substring(text, at + 1, F.char_length(text))
        letter = lambda n: F.substring(F.lit(_LETTERS), roll(F.lit(n), 14) + 1, F.lit(1))
        return F.when(F.char_length(text) == 0, text).when(kind == 0, F.concat(head, letter(52), after)).when(kind == 1, F.concat(head, after)).otherwise(F.concat(head, letter(26), rest))

    made = lambda n, text=None, rows=None: F.struct(F.lit(n).alias("operator"), (F.lit(None).cast("string") if text is None else text).alias("text"), (items if rows is None else rows).alias("items"))
    changed = lambda n, new, old: _let(new, lambda v: F.when((v != "") & (v != c(old)), made(n, v)))
    at = lambda raw, salt, new: _let(digits(c(raw)), lambda d: _let(F.get(d, pick(F.size(d), salt)), new))
    slipped = lambda v: F.when(F.contains(c("_slip_raw"), F.lit(".")) | c("_ratio").isin("0.1", "0.01"), two(v)).otherwise(v.cast("decimal(38,0)").cast("string"))
    cut = lambda raw, i, j, mid="": F.concat(F.substring(c(raw), F.lit(1), i - 1), mid if isinstance(mid, Column) else F.lit(mid), F.substring(c(raw), j, F.char_length(c(raw))))
    flipped = lambda v: F.when(v > 0, F.concat(F.lit("-"), plain(tax))).otherwise(F.replace(plain(tax), F.lit("-"), F.lit("")))
    gone, twin = pick(F.size(items), 15), pick(F.size(items), 16) + 1

    def bent(amount: Column) -> Column:
        skewed = two(amount * one_of(SKEWS, 19).cast("decimal(6,2)"))
        return F.transform(items, lambda x, i: F.when((i == c("_skew_at")) & c("_by_quantity"), x.withField("quantity", skewed)).when(i == c("_skew_at"), x.withField("unit_price", skewed)).otherwise(x))

    ops = {
        "decimal_slip": changed("decimal_slip", _let(parse_amount(c("_slip_raw")) * c("_ratio").cast("decimal(6,2)"), slipped), "_slip_raw"),
        "digit_drop": changed("digit_drop", at("_drop_raw", 4, lambda i: cut("_drop_raw", i, i + 1)), "_drop_raw"),
        "digit_insert": changed("digit_insert", at("_put_raw", 6, lambda i: cut("_put_raw", i, i, pick(10, 7).cast("string"))), "_put_raw"),
        "field_swap": F.when((n >= 2) & (c("_x_value") != c("_y_value")), made("field_swap")),
        "tax_sign_flip": _let(parse_amount(tax), lambda v: F.when(v != 0, made("tax_sign_flip", flipped(v)))),
        "ocr_confusion": changed("ocr_confusion", F.get(F.array_sort(F.filter(F.array(*swaps), lambda x: x["new"].isNotNull())), F.lit(0))["new"], "_mix_raw"),
        "date_format_swap": changed("date_format_swap", F.regexp_replace("_day", r"^(\d{1,2})([/\-.])(\d{1,2})([/\-.])(\d{2,4})$", "$3$2$1$4$5"), "_day"),
        "vendor_perturb": changed("vendor_perturb", F.when(F.char_length(vendor) >= 3, F.aggregate(F.sequence(F.lit(1), n_edits), vendor, edit)), "vendor_name"),
        "line_item_drop": F.when(F.size(items) >= 2, made("line_item_drop", rows=F.filter(items, lambda _, i: i != gone))),
        "line_item_duplicate": F.when(F.size(items) >= 1, made("line_item_duplicate", rows=F.concat(F.slice(items, F.lit(1), twin), F.slice(items, twin, F.lit(1)), F.slice(items, twin + 1, F.size(items))))),
        "quantity_price_skew": _let(parse_amount(c("_skew_raw")), lambda v: F.when(v != 0, made("quantity_price_skew", rows=bent(v)))),
        "currency_mismatch": F.when(~F.contains(c("_mark_raw"), c("_mark")), F.when(parse_amount(c("_mark_raw")).isNotNull(), made("currency_mismatch", F.concat(c("_mark"), plain(c("_mark_raw")))))),
    }
    text = c("made")["text"]
    changes: dict[str, list[tuple[str, Column, Column]]] = {x: [] for x in FIELDS}
    for name, of, columns in (("decimal_slip", "_slip_of", AMOUNTS), ("digit_drop", "_drop_of", AMOUNTS), ("digit_insert", "_put_of", AMOUNTS), ("ocr_confusion", "_mix_of", seen), ("currency_mismatch", "_mark_of", AMOUNTS)):
        for x in columns:
            changes[x].append((name, c(of) == x, text))
    for x in AMOUNTS:
        changes[x] += [("field_swap", c("_x") == x, c("_y_value")), ("field_swap", c("_y") == x, c("_x_value"))]
    for name, x in (("tax_sign_flip", "tax"), ("date_format_swap", "date"), ("vendor_perturb", "vendor_name")):
        changes[x].append((name, F.lit(True), text))
    return df, ops, changes


OPERATORS = ("decimal_slip", "digit_drop", "digit_insert", "field_swap", "tax_sign_flip", "ocr_confusion", "date_format_swap", "vendor_perturb", "line_item_drop", "line_item_duplicate", "quantity_price_skew", "currency_mismatch")


def corrupt(wide: DataFrame, k: int = 1, seed: int = 7) -> DataFrame:
    """k corrupted copies of each row, by the first operator that applies of the first TRIED in a hash-shuffled order (none: no copy);
    columns copy and operator are added."""
    u = F.xxhash64("document_id", "copy", F.lit(seed))
    df, ops, changes = _corruptions(wide.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_u", u))
    order = F.array_sort(F.array(*[F.struct(F.xxhash64("_u", F.lit(n)).alias("h"), F.lit(n).alias("n")) for n in ops]))
    none = F.lit(None).cast(f"struct<operator:string,text:string,items:{wide.schema['items'].dataType.simpleString()}>")
    # Operators are tried one after the other: coalesce and CASE work out no more than what is reached.
    tried = lambda found, x: F.coalesce(found, F.coalesce(*[F.when(x["n"] == n, new) for n, new in ops.items()]))
    made = F.filter(F.array(F.aggregate(F.slice(order, 1, TRIED), none, tried)), lambda x: x.isNotNull())
    # explode keeps the optimizer from writing the choice out in every column.
    df = df.select("*", F.explode(made).alias("made"))
    operator, changed = F.col("made")["operator"], {}
    for x, cases in changes.items():
        if cases:
            changed[x] = F.coalesce(*[F.when((operator == n) & when, new) for n, when, new in cases], F.col(x))
    return df.withColumns({**changed, "items": F.col("made")["items"], "operator": operator}).select(*wide.columns, "copy", "operator")


def training_set(clean: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None, k: int = 3, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Clean rows (1), k corrupted copies of each (0), corrected documents before (0) and after (1) with weight 4, unless both are identical; a share of each label, one row at least, is for validation. All rows are a stored table before they are split."""
    base = clean.withColumns({"label": F.lit(1), "weight": F.lit(1.0), "operator": F.lit("clean"), "copy": F.lit(0)})
    out = base.unionByName(corrupt(clean, k, seed).withColumns({"label": F.lit(0), "weight": F.lit(1.0)}))
    if before is not None and after is not None:
        print_of = lambda df, name: df.select("document_id", F.sha2(F.to_json(F.struct(*FIELDS, "items")), 256).alias(name))
        same = print_of(before, "b").join(print_of(after, "a"), "document_id").where("a = b").select("document_id")
        before, after = (df.join(same, "document_id", "left_anti") for df in (before, after))
        real = lambda df, y: df.withColumns({"label": F.lit(y), "weight": F.lit(4.0), "operator": F.lit("correction"), "copy": F.lit(y)})
        out = out.unionByName(real(before, 0)).unionByName(real(after, 1))
    # The rows of least hash of a label are for validation: all of the lower of 2^16 hash ranges, and of one range the first few.
    h = F.xxhash64("document_id", "copy", "operator", F.lit(seed))
    out = stored(out.withColumns({"_h": h, "_g": F.shiftright(h, 48).cast("int")}), "labelled-rows")
    ranges = out.groupBy("label", "_g").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("label").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(1), F.bround(F.sum("_n").over(Window.partitionBy("label")) * share, 0)) - F.coalesce(F.sum("_n").over(upto), F.lit(0))
    ranges = ranges.select("label", "_g", "_n", left.cast("long").alias("_left"))  # 2^16 rows a label at most
    # Only the range that is cut is put in order; its last validation row marks the cut for all others, which aren't shuffled.
    cut = F.broadcast(ranges.where("_left > 0 and _left <= _n"))
    place = F.struct("_h", "document_id", "copy")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_h", "document_id", "copy"))
    last = out.select("label", "_g", "_h", "document_id", "copy").join(cut, ["label", "_g"]).withColumn("_rank", rank).where("_rank = _left")
    last = last.select("label", place.alias("_last"))  # a row a label
    return out.join(F.broadcast(last), "label", "left").withColumn("validation", F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_h", "_g", "_last")


@dataclass
class Verifier:
    model: Boosted
    calibrator: object
    threshold: float
    means: dict[str, float]
    schema_hash: str = SCHEMA_HASH
    metrics: dict[str, float] = field(default_factory=dict)
    recalls: dict[str, float] = field(default_factory=dict)


def train_verifier(labelled: DataFrame, rounds: int = 200, step: float = 0.05, leaves: int = 31, least_rows: int = 5) -> Verifier:
    """Boosted trees on the features, rows of both labels weighing alike; isotonic calibration, the best-F1 threshold and metrics on the validation rows."""
    labelled = labelled.select("label", "weight", "validation", "operator", *FEATURES).persist()
    n = labelled.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    train, held = labelled.where("not validation"), labelled.where("validation")
    of_train = train.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    positive = (of_train.n - of_train.p) / max(of_train.p, 1)
    weighted = train.withColumn("w", F.col("weight") * F.when(F.col("label") == 1, positive).otherwise(1.0))
    model = boosted(weighted, list(FEATURES), weight="w", rounds=rounds, step=step, leaves=leaves, least_rows=least_rows)
    scored = held.withColumn("raw", model.probability(list(FEATURES))).select("raw", F.col("label").cast("double").alias("label"), "weight", "operator").persist()
    iso = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored)
    cal = iso.transform(scored).select(F.col("prediction").alias("p"), "raw", F.col("label").cast("int").alias("label"), "operator").persist()
    t = best_threshold(cal.select("p", "label")).first()
    rank = ranking_metrics(cal.select("p", "label")).first()
    error = lambda c: float(ece(cal.select(F.col(c).alias("p"), "label")).agg(F.coalesce(F.sum("ece_part"), F.lit(0.0))).first()[0])
    metrics = {"positives": int(n.p), "negatives": int(n.n - n.p), "auroc": rank.auroc, "auprc": rank.auprc, "f1": t.f1, "ece_before": error("raw"), "ece_after": error("p"), "trees": len(model.trees)}
    recalls = {r.operator: float(r.recall) for r in recall_by_operator(cal.select("p", "label", "operator"), float(t.threshold)).collect()}  # a row per operator
    means = train.where("label = 1").agg(*[F.avg(f).alias(f) for f in FEATURES]).first().asDict()
    for df in (cal, scored, labelled):
        df.unpersist()
    return Verifier(model, iso, float(t.threshold), {k: float(v or 0.0) for k, v in means.items()}, metrics=metrics, recalls=recalls)


def save_verifier(verifier: Verifier, spark: SparkSession, path: str) -> None:
    """The trees, their calibration and what scoring needs to know, in one folder."""
    verifier.model.save(spark, f"{path}/model")
    verifier.calibrator.write().overwrite().save(f"{path}/calibration")
    card = {"threshold": verifier.threshold, "means": verifier.means, "schema_hash": verifier.schema_hash, "metrics": verifier.metrics, "recalls": verifier.recalls}
    spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load_verifier(spark: SparkSession, path: str) -> Verifier:
    card = json.loads(spark.read.text(f"{path}/card").first()[0])
    return Verifier(Boosted.load(spark, f"{path}/model"), IsotonicRegressionModel.load(f"{path}/calibration"), **card)


def score(df: DataFrame, verifier: Verifier | None) -> DataFrame:
    """Adds p, ok and, for low plausibility, the three features farthest from clean means. No model, or one of another schema: all rows are skipped, ok."""
    if verifier is None or verifier.schema_hash != SCHEMA_HASH:
        return df.withColumns({"p": F.lit(None).cast("double"), "ok": F.lit(True), "reason": F.lit("skipped"), "top_features": F.array().cast("array<string>")})
    cal = verifier.calibrator.transform(df.withColumn("raw", verifier.model.probability(list(FEATURES)))).withColumnRenamed("prediction", "p").drop("raw")
    off = F.array(*[F.struct((-F.abs(F.col(f) - verifier.means[f]) / (abs(verifier.means[f]) + 1.0)).alias("d"), F.lit(f).alias("f")) for f in FEATURES])
    ok = F.col("p") >= verifier.threshold
    return cal.withColumns({"ok": ok, "reason": F.when(~ok, "low_plausibility"), "top_features": F.when(~ok, F.transform(F.slice(F.array_sort(off), 1, 3), lambda x: x["f"])).otherwise(F.array().cast("array<string>"))})


def supplier_risk_ml(metrics: DataFrame, trees: int = 50, seed: int = 42) -> DataFrame:
    """Forest on (mean confidence, documents) and the heuristic label (risk of 50 or more), scored as a probability; the heuristic itself with under five suppliers or one label. The method says which."""
    base = stored(supplier_risk(metrics).withColumn("label", (F.col("risk_score") >= 50).cast("int")), "supplier-risk")
    n = base.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if n.n < 5 or n.p in (0, n.n):
        return base.drop("label").withColumn("method", F.lit("heuristic"))
    x = VectorAssembler(inputCols=["avg_confidence", "total_documents"], outputCol="features").transform(base)
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(x)
    return model.transform(x).select(*[c for c in metrics.columns if c != "risk_score"], F.round(vector_to_array("probability")[1] * 100, 2).alias("risk_score"), F.lit("random_forest").alias("method"))


def update_supplier_risk(target: DataFrame, metrics: DataFrame) -> DataFrame:
    """target (the columns of metrics) with every supplier's learned risk put in, one row a supplier."""
    return upsert(target, supplier_risk_ml(metrics).drop("method"), ["supplier_name"], "total_documents")


def target_json(wide: DataFrame) -> DataFrame:
    """Training target of each document: all keys, nulls too, items with numbers."""
    number = lambda x, c: F.regexp_replace(x[c], r"[^0-9.\-]", "").try_cast("double").alias(c)
    items = F.transform(F.coalesce("items", F.expr("array()").cast(wide.schema["items"].dataType)), lambda x: F.struct(x["description"].alias("description"), number(x, "quantity"), number(x, "unit_price"), number(x, "total")))
    return wide.select("document_id", F.to_json(F.struct(*FIELDS, items.alias("line_items")), {"ignoreNullFields": "false"}).alias("target"))
