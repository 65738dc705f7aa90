"""Amounts and dates in text: three cast rules, the exact currency parser, date formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What float() of a text accepts, but for signed infinities and NaN, which are no amounts here.
FLOAT = r"^\s*[+-]?(\d+(_?\d)*)?(\.(\d+(_?\d)*)?)?([eE][+-]?\d+)?\s*$"
EXACT = "decimal(38,6)"
#: Formats of dates, first match wins, each with the shape that guards it.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"), ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), ("MMMM d, yyyy", r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$"),
)


def amt_float(text: Column) -> Column:
    """A plain float, null where the text is none. Digits are needed; trailing letters, as in 1d, aren't taken."""
    clean = F.trim(F.replace(text, F.lit("_"), F.lit("")))
    return F.when(text.rlike(FLOAT) & text.rlike(r"\d"), clean.try_cast("double"))


def amt_bi(text: Column) -> Column:
    """Commas and dollar signs go first."""
    return amt_float(F.translate(text, ",$", ""))


def _bare(text: Column) -> Column:
    """Without currency marks at the ends and without white space."""
    t = F.regexp_replace(F.trim(text), r"^(?i:\s*(usd|eur|gbp|[$€£]))+", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?i:(usd|eur|gbp)\s*)+$", ""), r"\s+", "")


def _plain(bare: Column) -> Column:
    """Without thousands commas, or null where these are wrong."""
    whole = F.when(F.instr(bare, ".") > 0, F.regexp_extract(bare, r"^(.*)\.[^.]*$", 1)).otherwise(bare)
    tail = F.when(F.instr(bare, ".") > 0, F.regexp_extract(bare, r"\.([^.]*)$", 1)).otherwise(F.lit(""))
    grouped = F.concat(F.replace(whole, F.lit(","), F.lit("")), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""))
    right = F.when(F.instr(whole, ",") > 0, whole.rlike(r"^-?\d+(,\d{3})+$")).otherwise(True)
    return F.when(F.instr(bare, ",") == 0, bare).when(right, grouped)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_amount(text: Column) -> Column:
    """Exact decimal of a currency text, null where it is not one (amount_error says why)."""
    number = lambda plain: F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.try_cast(EXACT))
    # Digits alone need nothing else.
    return F.when(text.rlike(r"^\d+(\.\d+)?\z"), text.try_cast(EXACT)).otherwise(_let(_bare(text), lambda bare: _let(_plain(bare), number)))


def amount_text(text: Column) -> Column:
    """The digits of a currency text as an exact number is written: no marks, commas or leading zeros; null where it is none."""
    digits = lambda plain: F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1"))
    return _let(_bare(text), lambda bare: _let(_plain(bare), digits))


def amount_error(text: Column) -> Column:
    """empty, thousands, or not_a_number; null for a good amount."""
    why = lambda bare: F.when(bare == "", "empty").when(_plain(bare).isNull(), "thousands").when(parse_amount(text).isNull(), "not_a_number")
    return F.when(text.isNull(), "empty").otherwise(_let(_bare(text), why))


def parse_date_any(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, fmt)) for fmt, shape in DATE_FORMATS])


def normalize_date(text: Column) -> Column:
    """US slash dates and written dates as ISO; other texts as they are."""
    part = lambda i: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
    slash = F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))
    written = F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, fmt)) for fmt, shape in DATE_FORMATS if "MMM" in fmt])
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), slash).otherwise(F.coalesce(F.date_format(written, "yyyy-MM-dd"), text))


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)
