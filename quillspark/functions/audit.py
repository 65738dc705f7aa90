"""The exact audit subtotal + tax = total, and magnitude slips of a failed one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import amount_text, parse_amount

TOLERANCE = "0.01"
#: Ratios by which an amount may have slipped, and the fields, in order of trial.
RATIOS = ("10", "100", "0.1", "0.01")
SLIP_FIELDS = ("subtotal", "tax", "total")


def _dec(text: str) -> Column:
    return F.lit(text).cast("decimal(38,10)")


def audit(invoices: DataFrame) -> DataFrame:
    """Adds total, subtotal_amt, tax_amt, delta, audit_reason and audit_ok to rows of texts total_amount, subtotal, tax.

    An unreadable subtotal or tax counts as missing; an unreadable total is an error of its own.
    """
    has_total = F.coalesce(F.trim("total_amount"), F.lit("")) != ""
    df = invoices.withColumns({"total": parse_amount(F.col("total_amount")), "subtotal_amt": parse_amount(F.col("subtotal")), "tax_amt": parse_amount(F.col("tax"))})
    delta = (F.col("subtotal_amt") + F.col("tax_amt") - F.col("total")).cast("decimal(38,6)")
    reason = (
        F.when(has_total & F.col("total").isNull(), "unreadable_total")
        .when(F.col("total").isNull(), "missing_total")
        .when(F.col("subtotal_amt").isNull() | F.col("tax_amt").isNull(), "partial_data")
        .when(F.abs(delta) > _dec(TOLERANCE), "math_mismatch")
    )
    df = df.withColumn("delta", delta).withColumn("audit_reason", reason)
    return df.withColumn("audit_ok", F.col("audit_reason").isNull() | (F.col("audit_reason") == "partial_data"))


def _balanced(left: Column, right: Column) -> Column:
    return F.when(right == 0, F.abs(left) <= _dec(TOLERANCE)).otherwise(F.abs(left - right) * 100 <= F.abs(right))


def magnitude_slip(audited: DataFrame, items_total: str | None = None) -> DataFrame:
    """Adds slip_field, slip_ratio and slip_direction: the first ratio and field whose correction balances a math mismatch.

    Failing that, and if the items' sum is given and not 0, a total that is about a ratio times it (5%).
    A part times the ratio balances if it was read too small by it; for the total, which is divided, it is the other
    way round. The items' fallback gives no direction.
    """
    s, t, total = (F.col(c).cast("decimal(28,6)") for c in ("subtotal_amt", "tax_amt", "total"))

    def hit(ok: Column, field: str, ratio: str, direction: str | None) -> Column:
        return F.when(ok, F.struct(F.lit(field).alias("field"), F.lit(ratio).alias("ratio"), F.lit(direction).cast("string").alias("direction")))

    options = []
    for ratio in RATIOS:
        r, up = F.lit(ratio).cast("decimal(6,2)"), float(ratio) > 1
        options.append(hit((s != 0) & _balanced(s * r + t, total), "subtotal", ratio, "too_small" if up else "too_large"))
        options.append(hit((t != 0) & _balanced(s + t * r, total), "tax", ratio, "too_small" if up else "too_large"))
        options.append(hit(F.when(total == 0, F.abs(s + t) <= _dec(TOLERANCE)).otherwise(_balanced((s + t) * r, total)), "total", ratio, "too_large" if up else "too_small"))
    if items_total:
        items = F.col(items_total).cast("decimal(28,6)")
        for ratio in RATIOS:
            r = F.lit(ratio).cast("decimal(6,2)")
            options.append(hit((items != 0) & (F.abs(total - items * r) * 100 <= F.abs(items * r) * 5), "total", ratio, None))
    slip = F.when(F.col("audit_reason") == "math_mismatch", F.coalesce(*options))
    return audited.withColumn("slip", slip).withColumns({f"slip_{c}": F.col(f"slip.{c}") for c in ("field", "ratio", "direction")}).drop("slip")


def slip_sentence(slips: DataFrame, items_total: str | None = None) -> DataFrame:
    """Adds slip_text to the rows of magnitude_slip: guidance on which field to read again, null where nothing slipped.

    Amounts are written as their texts have them, without marks and commas; the items' sum (only named where it gave the slip) with two decimals.
    """
    given = {n: amount_text(F.col(c)) for n, c in (("subtotal", "subtotal"), ("tax", "tax"), ("total", "total_amount"))}
    field, ratio = F.col("slip_field"), F.col("slip_ratio")
    # The sentences.
    one = F.concat(
        F.lit("magnitude_error: likely decimal-point slip in "), field, F.lit(" \u2014 reported "), field, F.lit(" appears "), F.replace(F.col("slip_direction"), F.lit("_"), F.lit(" ")), F.lit(" by a factor of ~"), ratio,
        F.lit(" relative to the other two fields. Observed: subtotal="), given["subtotal"], F.lit(", tax="), given["tax"], F.lit(", total="), given["total"],
        F.lit(". Re-scan the "), field, F.lit(" field digit by digit and verify decimal placement before returning a value."),
    )
    total = F.col(items_total).cast("decimal(38,2)").cast("string") if items_total else F.lit(None).cast("string")
    items = F.concat(
        F.lit("magnitude_error: the reported total ("), given["total"], F.lit(") is ~"), ratio, F.lit("x the sum of line items ("), total,
        F.lit("). The subtotal+tax triangulation was inconclusive, so a line item may also be mis-extracted. Re-scan every line item's amount and the total field, verifying decimal placement."),
    )
    return slips.withColumn("slip_text", F.when(F.col("slip_direction").isNotNull(), one).when(field.isNotNull(), items))
