"""Text measures: normalisers, edit distances, match classes, token F1, JSON in model replies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .amounts import _let

AMOUNT_FIELDS = ("subtotal", "tax", "total_amount")
REPLY_KEYS = ("invoice_number", "date", "vendor_name", "subtotal", "tax", "total_amount")
#: Fixed value: currency marks that a normalised text loses.
CURRENCY = r"(?i)(rs\.?|pkr|inr|usd|\$|€|£|/-)"


def norm_text(text: Column) -> Column:
    """Lower case, no currency marks or commas, single spaces; null for nothing left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), CURRENCY, ""), r"\s+", " "))
    return F.nullif(F.replace(bare, F.lit(","), F.lit("")), F.lit(""))


def norm_plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def norm_amount(text: Column) -> Column:
    """Digits, sign and dot of a text, to two places; null if that's no number."""
    return F.format_string("%.2f", F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double"))


def _amount(text: Column) -> Column:
    return F.when(norm_text(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), norm_text(text).try_cast("decimal(38,6)"))


def match_class(pred: Column, truth: Column, field: Column) -> Column:
    """exact, numeric_ok, fuzzy, wrong, miss, hallucination or both_null."""
    p, t = norm_text(pred), norm_text(truth)
    return (
        F.when(truth.isNull() & pred.isNull(), "both_null")
        .when(truth.isNull(), "hallucination")
        .when(pred.isNull(), "miss")
        .when(pred == truth, "exact")  # without normalising
        .when(p.eqNullSafe(t), "exact")
        .when(field.isin(*AMOUNT_FIELDS) & (F.abs(_amount(pred) - _amount(truth)) <= F.lit("0.02").cast("decimal(4,2)")), "numeric_ok")
        .when(F.levenshtein(p, t, 2) >= 0, "fuzzy")  # -1: more than two
        .otherwise("wrong")
    )


def edits(a: Column, b: Column) -> Column:
    """Character edits. Where one text begins with the other they are what it goes on with: no table of costs."""
    n, m = F.char_length(a), F.char_length(b)
    return F.when(F.startswith(a, b), n - m).when(F.startswith(b, a), m - n).otherwise(F.levenshtein(a, b))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character edits over the reference's length; with an empty reference, over the hypothesis's (1 at least)."""
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    return edits(r, h) / F.when(F.char_length(r) > 0, F.char_length(r)).otherwise(F.greatest(F.char_length(h), F.lit(1)))


#: White space that parts words, within and outside ASCII.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _cells(a: Column, b: Column) -> Column:
    """Rows of the edit-distance table of two arrays: row i is an array of costs."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j)

    def next_row(rows: Column, x: Column) -> Column:
        last = F.element_at(rows, -1)
        row = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))),
            F.array(F.element_at(last, 1) + 1),
            lambda acc, j: F.when(j > F.size(b), acc).otherwise(
                F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, F.get(last, j) + 1, F.get(last, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))))
            ),
        )
        return F.concat(rows, F.array(row))

    return F.aggregate(a, F.array(first), next_row)


def edit_ops(a: Column, b: Column) -> Column:
    """(s, d, i, c) between two arrays (reference, hypothesis). The path is walked from the end: match, else
    substitution, else deletion, else insertion."""
    n = lambda x: x.cast("int")
    start = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), *[F.lit(0).alias(k) for k in "sdnc"])

    def step(p: Column, table: Column) -> Column:
        i, j = p["i"], p["j"]
        here = F.get(F.get(table, i), j)
        diag, up = F.get(F.get(table, i - 1), j - 1), F.get(F.get(table, i - 1), j)
        both = (i > 0) & (j > 0)
        match = both & (F.get(a, i - 1) == F.get(b, j - 1)) & (diag == here)
        sub = ~F.coalesce(match, F.lit(False)) & both & (diag + 1 == here)
        match, sub = F.coalesce(match, F.lit(False)), F.coalesce(sub, F.lit(False))
        dele = ~match & ~sub & F.coalesce((i > 0) & (up + 1 == here), F.lit(False))
        ins = ~match & ~sub & ~dele & (j > 0)
        return F.struct(n(i - n(match) - n(sub) - n(dele)).alias("i"), n(j - n(match) - n(sub) - n(ins)).alias("j"), (p["s"] + n(sub)).alias("s"), (p["d"] + n(dele)).alias("d"), (p["n"] + n(ins)).alias("n"), (p["c"] + n(match)).alias("c"))

    table = _cells(a, b)
    walked = F.element_at(F.transform(F.array(table), lambda t: F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b) + 1), start, lambda p, _: F.when((p["i"] == 0) & (p["j"] == 0), p).otherwise(step(p, t)))), 1)
    return F.struct(walked["s"].alias("s"), walked["d"].alias("d"), walked["n"].alias("i"), walked["c"].alias("c"))


#: One substitution, deletion and insertion in a packed count: 21 bits each, for texts of up to two million characters.
_SUB, _DEL, _INS = 1, 1 << 21, 1 << 42


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _path_counts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows (s, d, i, c) of edit_ops, of pairs of number sequences (not negative) that are gone through together.

    A path's next step is decided at the cell where it stands, so a cell's counts are those of the cell that its step leads to, and one more. Going
    forward, a row of costs and one of packed counts are all that is kept: memory grows with one text's length.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    a, b = np.full((len(pairs), n.max()), -1, np.int32), np.full((len(pairs), m.max()), -2, np.int32)
    for r, (x, y) in enumerate(pairs):
        a[r, : len(x)], b[r, : len(y)] = x, y
    rows, at = np.arange(len(pairs)), np.arange(m.max() + 1, dtype=np.int32)
    cost, count = np.repeat(at[None, :], len(pairs), axis=0), np.repeat(at[None, :].astype(np.int64) * _INS, len(pairs), axis=0)
    found = np.where(n == 0, count[rows, m], 0)
    for i in range(1, n.max() + 1):
        other = a[:, i - 1, None] != b
        new, diagonal, up = np.empty_like(cost), cost[:, :-1] + other, cost[:, 1:] + 1
        new[:, 0] = i
        np.minimum(diagonal, up, out=new[:, 1:])
        new = np.minimum.accumulate(new - at, axis=1) + at  # insertions
        counted = np.empty_like(count)
        counted[:, 0] = i * _DEL
        kept = diagonal == new[:, 1:]  # a match where the characters agree, else a substitution
        counted[:, 1:] = np.where(kept, count[:, :-1] + other * _SUB, count[:, 1:] + _DEL)
        inserted = ~kept & (up != new[:, 1:])
        if inserted.any():  # steps along the row, from the last cell that is none
            place = np.zeros(new.shape, np.int32)
            place[:, 1:] = np.where(inserted, 0, at[1:])
            place = np.maximum.accumulate(place, axis=1)
            counted = np.take_along_axis(counted, place, axis=1) + (at - place).astype(np.int64) * _INS
        cost, count = new, counted
        done = n == i
        found[done] = count[rows[done], m[done]]
    s, d, k = found & (_DEL - 1), found // _DEL & (_DEL - 1), found // _INS
    return np.stack([s, d, k, n - s - d], axis=1).astype(np.int32)


def _all_counts(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """_path_counts of all pairs: a common ending is matched first, and pairs of like lengths go together, up to some 16 MB of rows."""
    out, todo = np.zeros((len(pairs), 4), np.int32), []
    for k, (a, b) in enumerate(pairs):
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
        same = n - 1 - int(apart[-1]) if len(apart) else n
        out[k, 3] = same
        if len(a) > same or len(b) > same:
            todo.append((k, a[: len(a) - same], b[: len(b) - same]))
    todo.sort(key=lambda x: (len(x[1]), len(x[2])))
    while todo:
        size, widest = 0, 0
        while size < len(todo):
            widest = max(widest, len(todo[size][1]), len(todo[size][2]))
            if size and (size + 1) * (widest + 1) > 1 << 18:
                break
            size += 1
        now, todo = todo[:size], todo[size:]
        out[[x[0] for x in now]] += _path_counts([x[1:] for x in now])
    return out


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in "sdic"]))
def _text_ops(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    found = np.zeros((len(reference), 4), np.int32)
    some = np.flatnonzero((reference != "") | (hypothesis != ""))
    if len(some):
        found[some] = _all_counts([(_points(reference.iloc[k]), _points(hypothesis.iloc[k])) for k in some])
    return pd.DataFrame(found, columns=list("sdic"))


@F.pandas_udf(IntegerType())
def _word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edits between lists of words, which are numbered."""
    pairs, found = [], np.zeros(len(reference), np.int32)
    some = [k for k, (a, b) in enumerate(zip(reference, hypothesis, strict=True)) if len(a) or len(b)]
    for a, b in ((reference.iloc[k], hypothesis.iloc[k]) for k in some):
        known: dict[str, int] = {}
        pairs.append(tuple(np.array([known.setdefault(w, len(known)) for w in x], np.int32) for x in (a, b)))
    if some:
        found[some] = _all_counts(pairs)[:, :3].sum(axis=1)
    return pd.Series(found)


def text_edit_ops(reference: Column, hypothesis: Column) -> Column:
    """edit_ops of two texts' characters, for many rows: those of a batch are gone through together, in memory that grows with a text's length.

    Where one text begins with the other all paths match it and delete or insert the rest; only other pairs are walked.
    """
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    plain = F.startswith(r, h) | F.startswith(h, r)
    n, m = F.char_length(r), F.char_length(h)
    walked = _text_ops(F.when(plain, F.lit("")).otherwise(r), F.when(plain, F.lit("")).otherwise(h))
    known = {"s": F.lit(0), "d": F.greatest(n - m, F.lit(0)), "i": F.greatest(m - n, F.lit(0)), "c": F.least(n, m)}
    return F.struct(*[F.when(plain, v).otherwise(walked[k]).alias(k) for k, v in known.items()])


def normalized_cer(reference: Column, hypothesis: Column) -> Column:
    """Edits over edits and matches of the edit path; two empty texts: 0.

    With at most one edit more than the lengths differ by, all paths have the same matches: the longer length less the edits. Only other pairs are walked.
    """
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    n, m, e = F.char_length(r), F.char_length(h), edits(r, h)
    plain = e - F.abs(n - m) <= 1
    c = F.when(plain, F.greatest(n, m) - e).otherwise(_text_ops(F.when(plain, F.lit("")).otherwise(r), F.when(plain, F.lit("")).otherwise(h))["c"])
    return F.coalesce(e / F.nullif(e + c, F.lit(0)), F.lit(0.0))


def chars(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


#: Pairs of more distinct words are numbered in Python: a place in an array is found by going through it.
WORDS_IN_PLACE = 1000


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edits between two word lists. Each distinct word is written as one character, so that levenshtein counts words."""
    bound = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  # v is computed once
    code = lambda ws, known: F.decode(F.unhex(F.concat_ws("", F.transform(ws, lambda w: F.hex(F.array_position(known, w) + 0x4E00)))), "UTF-16BE")
    a, b = words(reference), words(hypothesis)
    r, h = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    few = (r == h) | (F.char_length(r) + F.char_length(h) <= WORDS_IN_PLACE) | (F.size(F.array_distinct(F.concat(a, b))) <= WORDS_IN_PLACE)
    in_place = bound(F.struct(a.alias("a"), b.alias("b")), lambda p: bound(F.array_distinct(F.concat(p["a"], p["b"])), lambda known: F.levenshtein(code(p["a"], known), code(p["b"], known))))
    none = F.array().cast("array<string>")
    return F.when(r == h, 0).when(h == "", F.size(a)).when(few, in_place).otherwise(_word_distance(F.when(few, none).otherwise(a), F.when(few, none).otherwise(b)))


def wer(reference: Column, hypothesis: Column) -> Column:
    n, m = F.size(words(reference)), F.size(words(hypothesis))
    return word_edits(reference, hypothesis) / F.when(n > 0, n).otherwise(F.greatest(m, F.lit(1)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the multisets of lower-cased word tokens; both empty: 1, one empty: 0."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = (F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), F.lit(1)) for c in (a, b))
    count = lambda arr, t: F.size(F.filter(arr, lambda z: z == t))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(count(x, t), count(y, t)))
    return F.when(a == b, 1.0).when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(x) + F.size(y)))


def parse_reply(reply: Column) -> Column:
    """(reason, fields, items) of a model's reply: the widest {...}; reasons empty_output, no_json_found, json_decode_error."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    shape = "struct<" + ",".join(f"{k}:string" for k in REPLY_KEYS) + ",line_items:array<struct<description:string,quantity:string,unit_price:string,total:string>>>"
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "null", "none", "n/a"), c)

    def read(x: Column) -> Column:
        """Of a struct of the body, and whether it is JSON: read once for all columns."""
        reason = F.when(F.trim(F.coalesce(reply, F.lit(""))) == "", "empty_output").when(x["body"].isNull(), "no_json_found").when(~x["good"], "json_decode_error")
        data = F.when(reason.isNull(), F.from_json(x["body"], shape, {"mode": "PERMISSIVE"}))
        return _let(F.struct(reason.alias("reason"), data.alias("data")), lambda d: F.struct(d["reason"].alias("reason"), *[clean(d["data"][k]).alias(k) for k in REPLY_KEYS], d["data"]["line_items"].alias("line_items")))

    return _let(body, lambda b: _let(F.struct(b.alias("body"), F.try_parse_json(b).isNotNull().alias("good")), read))
