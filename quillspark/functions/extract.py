"""Fields in document text, by ordered patterns; labels and amounts of text blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import amt_bi, normalize_date

_AMT = r"(?:\$|€|£)?\s*([\d,]+\.\d{1,2})"
_MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Patterns of each field, the first that gives something wins.
PATTERNS = {
    "invoice_number": (r"(?i)invoice\s*(?:no\.?|number|#)[:\s]*([A-Z0-9\-/]+)", r"\b(INV[-/][A-Z0-9\-/]+)\b"),
    "date": (r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{2}/\d{2}/\d{4})\b", r"\b(\d{2}-\d{2}-\d{4})\b", rf"(?i)\b(\d{{1,2}}\s+{_MONTHS}\s+\d{{4}})\b", rf"(?i)\b({_MONTHS}\s+\d{{1,2}},?\s+\d{{4}})\b"),
    "total_amount": (rf"(?i)(?:grand|invoice)\s+total[^\n\r]{{0,60}}?{_AMT}", rf"(?i)\btotal\s*(?:amount|due|payable)?[^\n\r]{{0,60}}?{_AMT}", rf"(?i)amount\s+(?:paid|due)[^\n\r]{{0,60}}?{_AMT}"),
    "subtotal": (rf"(?i)sub[-\s]?total[^\n\r]{{0,60}}?{_AMT}",),
    "tax": (rf"(?i)(?:tax|vat|gst|sales\s*tax)[^\n\r]{{0,60}}?{_AMT}",),
    "vendor_name": (r"(?im)^\s*(?:vendor|supplier|from)[:\s]+(.+?)$",),
}
#: Whole-block labels of each field, in order.
LABELS = {
    "total_amount": (
        r"(?i)^\s*grand\s+total\s*:?\s*$",
        r"(?i)^\s*invoice\s+total\s*:?\s*$",
        r"(?i)^\s*total\s+due\s*:?\s*$",
        r"(?i)^\s*total\s+payable\s*:?\s*$",
        r"(?i)^\s*total\s+amount\s*:?\s*$",
        r"(?i)^\s*amount\s+due\s*:?\s*$",
        r"(?i)^\s*amount\s+paid\s*:?\s*$",
        r"(?i)^\s*balance\s+due\s*:?\s*$",
        r"(?i)^\s*total\s*:?\s*$",
    ),
    "subtotal": (r"(?i)^\s*sub[-\s]?total\s*:?\s*$",),
    "tax": (r"(?i)^\s*(?:sales\s*tax|vat|gst|tax)\s*:?\s*$",),
    "invoice_number": (
        r"(?i)^\s*invoice\s*(?:no\.?|number|#)\s*:?\s*$",
        r"(?i)^\s*(?:invoice|inv)\s*#\s*$",
    ),
    "date": (
        r"(?i)^\s*(?:invoice\s+)?date\s*:?\s*$",
        r"(?i)^\s*due\s+date\s*:?\s*$",
    ),
    "vendor_name": (r"(?i)^\s*(?:vendor|supplier|from|bill\s+from)\s*:?\s*$",),
}
VALUE_ONLY = (r"(?i)^\s*(?:\$|€|£)\s*([\d,]+(?:\.\d{1,2})?)\s*$", r"^\s*([\d,]+\.\d{1,2})\s*$")


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first pattern's group that isn't empty, without a comma at its end."""
    return F.coalesce(*[_filled(F.rtrim(F.regexp_replace(F.regexp_extract(text, p, 1), r",+$", ""))) for p in patterns])


def _filled(text: Column) -> Column:
    """Null for an empty text. In a coalesce nullif would work out its text twice, this does it once."""
    return F.get(F.filter(F.array(text), lambda x: x != ""), F.lit(0))


def extract_fields(text: Column) -> dict[str, Column]:
    return {name: found(text, patterns) for name, patterns in PATTERNS.items()}


def block_label(text: Column) -> Column:
    """The first field of which a label matches. Most blocks have none: one search at the text's start tells."""
    any_of = {name: f"^(?:{'|'.join(ps)})" for name, ps in LABELS.items()}
    return F.when(text.rlike(f"^(?:{'|'.join(p for ps in LABELS.values() for p in ps)})"), F.coalesce(*[F.when(text.rlike(p), name) for name, p in any_of.items()]))


def may_be_amount(text: Column) -> Column:
    """Whether a block starts as amounts do."""
    return text.rlike(r"^\s*[$€£\d,]")


def block_amount(text: Column) -> Column:
    """The number of a block that is nothing but an amount, else null. Most blocks are none: their start tells."""
    return F.when(may_be_amount(text), F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in VALUE_ONLY]))

_NUM = r"([\d,]+\.\d{2})"
#: The receipt patterns, in order, and words that no merchant's line holds.
RECEIPT = {
    "invoice_number": (
        r"(?i)Invoice\s*#\s*([A-Za-z0-9\-_/]+)",
        r"(?i)Invoice\s*No\.?\s*[:\-]?\s*([A-Za-z0-9\-_/]+)",
        r"(?i)INVOICE\s*NO\.?\s*[:\-]?\s*([A-Za-z0-9\-_/]+)",
        r"(?i)Document\s*(?:No|Number)\s*[:\-]?\s*([A-Za-z0-9\-_/]+)",
        r"(?i)INV\s*#?\s*([A-Za-z0-9\-_/]+)",
    ),
    "date": (
        r"Date\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"Invoice\s*Date\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"Date\s*[:\-]?\s*([A-Za-z]{3,9}\s*\d{1,2},?\s*\d{4})",
        r"Invoice\s*Date\s*[:\-]?\s*([A-Za-z]{3,9}\s*\d{1,2},?\s*\d{4})",
        r"(\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b)",
    ),
    "tax_amount": (rf"(?i)Tax\s*@\s*\d+%[:\-]?\s*{_NUM}", rf"(?i)GST[:\-]?\s*{_NUM}", rf"(?i)SST[:\-]?\s*{_NUM}", rf"(?i)Sales\s*Tax[:\-]?\s*{_NUM}"),
    "subtotal": (rf"(?i)Sub\s*Total[:\-]?\s*{_NUM}", rf"(?i)Subtotal[:\-]?\s*{_NUM}"),
    "discount": (rf"(?i)Discount[:\-]?\s*{_NUM}",),
    "cash_tendered": (rf"(?i)Cash\s*Tendered[:\-]?\s*{_NUM}", rf"(?i)CASH[:\-]?\s*{_NUM}"),
    "change": (rf"(?i)Change[:\-]?\s*{_NUM}",),
}
TOTALS = (rf"(?i)Grand\s*Total\s*[:\-]?\s*{_NUM}", rf"(?i)Payable\s*[:\-]?\s*{_NUM}", rf"(?i)Total\s*Amount\s*[:\-]?\s*{_NUM}", rf"(?i)TOTAL\s*RM\s*{_NUM}", rf"(?i)Total\s*[:\-]?\s*{_NUM}")
NOT_MERCHANT = ("invoice", "receipt", "tax", "bill", "order", "cash", "total", "date", "tel", "phone", "www", "http")


def extract_receipt(text: Column) -> dict[str, Column]:
    """Ten receipt fields: the total is the largest match, the merchant the first of eight lines that looks like a name."""
    first = lambda ps: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ps])
    values = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double")) for p in TOTALS])
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""), 1, 8)
    name = lambda x: (F.char_length(x) >= 3) & ~(x.rlike(r"\d") & (F.char_length(x) < 6)) & ~F.lower(x).rlike("|".join(NOT_MERCHANT))
    out = {n: first(ps) for n, ps in RECEIPT.items()}
    return {"merchant_name": F.get(F.filter(lines, name), F.lit(0)), "total_amount": F.format_string("%.2f", F.array_max(F.array_compact(values))), "currency": F.lit(None).cast("string"), **out}


#: The keyword patterns: an invoice number, dates and what stands before them, amounts after their words.
KEYED_INVOICE = r"(?i)(?:Invoice|INV)[#:\s\-]*([A-Z]{0,4}-?\d{4}-?\d{3,5}|\d{4,10})"
KEYED_DATES = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}")
DATE_WORDS = r"(?:Date|Invoice\s*Date|Due\s*Date|Issued)[:\s]*"
KEYED_AMOUNT = r"\$?\s*([\d,]+\.\d{2})"
AMOUNT_WORDS = {
    "total_amount": r"(?:(?<!\w)Total\s*(?:Amount\s*)?(?:Due)?|Amount\s*Due|Balance\s*Due|Grand\s*Total)",
    "subtotal": r"(?:Subtotal|Sub\s*Total)",
    "tax": r"(?:(?<!\w)Tax|VAT|GST|Sales\s*Tax)",
}
#: Their confidence; a date's without its keyword is the last.
KEYED_CONFIDENCE = {"invoice_number": 0.92, "date": 0.93, "amount": 0.88, "lone_date": 0.90}
#: What a table's header has to hold to be a column of this field.
HEADERS = {
    "description": ("description", "item", "product", "service", "name"),
    "quantity": ("qty", "quantity", "units", "count"),
    "unit_price": ("price", "unit price", "rate", "unit cost"),
    "total": ("total", "amount", "line total", "ext"),
}


def extract_keyed(text: Column) -> dict[str, Column]:
    """Fields by keywords: the whole invoice mark, the date by its keyword (else any), amounts by theirs, and the largest amount where
    no total has one; with a confidence each, null where nothing is found (as in null and empty texts).

    Dates are tried by form, not by place: any ISO date by a keyword wins over the others. Amounts lose their commas.
    """
    match = lambda p, group: F.nullif(F.regexp_extract(text, p, group), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    near = F.coalesce(*[match(f"(?i){DATE_WORDS}({d})", 1) for d in KEYED_DATES])
    lone = F.coalesce(*[match(f"(?i){d}", 0) for d in KEYED_DATES])
    found = {n: F.replace(match(f"(?i){words}[:\\s]*{KEYED_AMOUNT}", 1), F.lit(","), F.lit("")) for n, words in AMOUNT_WORDS.items()}
    every = F.transform(F.regexp_extract_all(text, F.lit(KEYED_AMOUNT), F.lit(1)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))
    largest = F.array_max(F.array_compact(every))
    found["total_amount"] = F.coalesce(found["total_amount"], F.when(largest.isNotNull(), F.format_string("%.2f", largest)))
    number, known = trimmed(match(KEYED_INVOICE, 0)), KEYED_CONFIDENCE
    out = {"invoice_number": number, "date": normalize_date(trimmed(F.coalesce(near, lone))), **found}
    out["invoice_number_confidence"] = F.when(number.isNotNull(), known["invoice_number"])
    out["date_confidence"] = F.when(near.isNotNull(), known["date"]).when(lone.isNotNull(), known["lone_date"])
    return {**out, **{f"{n}_confidence": F.when(c.isNotNull(), known["amount"]) for n, c in found.items()}}


def items_from_tables(tables: Column) -> Column:
    """Line items (description, quantity, unit_price, total) of tables (arrays of rows of cells), in their order.

    The first row of a table is its header: a field's column is the first whose header holds one of the field's words. Rows without a
    description, tables of one row and those without a description's column give nothing. Cells that are missing or no numbers are 0.0; commas
    and dollar signs in numbers don't count. Null tables, rows and cells count as empty; null gives an empty array.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    none = F.array().cast("array<string>")

    def rows_of(table: Column) -> Column:
        header = F.transform(F.coalesce(F.get(table, F.lit(0)), none), lambda c: F.lower(bare(c)))
        held = lambda words: F.array_position(F.transform(header, lambda h: h.rlike("|".join(words))), True) - 1
        place = F.struct(*[held(words).cast("int").alias(n) for n, words in HEADERS.items()])

        def items(at: Column) -> Column:
            def item(row: Column) -> Column:
                cell = lambda n: bare(F.when(at[n] >= 0, F.get(row, at[n])))
                return F.struct(cell("description").alias("description"), *[F.coalesce(amt_bi(cell(n)), F.lit(0.0)).alias(n) for n in ("quantity", "unit_price", "total")])

            body = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))
            return F.filter(F.transform(body, lambda r: item(F.coalesce(r, none))), lambda x: x["description"] != "")

        return F.flatten(F.transform(F.array(place), items))

    return F.flatten(F.transform(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), lambda t: rows_of(F.coalesce(t, F.array().cast("array<array<string>>")))))


def extract_all(text: Column, given: dict[str, Column], paired: dict[str, Column]) -> dict[str, Column]:
    """Each field by precedence: the given value, what stands by its label in the layout, then the patterns. Blank counts as none.

    Amounts that are still missing are for operators.layout.triangulate, with these as known.
    """
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return {name: F.coalesce(*[filled(d[name]) for d in (given, paired) if name in d], pattern) for name, pattern in extract_fields(text).items()}
