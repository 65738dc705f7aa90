"""Secret scan: a trigram inverted index narrows each rule to candidate texts, which its regex then verifies."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of


@dataclass(frozen=True)
class Rule:
    """``keep`` is the group whose length must be at least ``least``; the span is the whole match."""

    kind: str
    regex: str
    keep: int = 0
    least: int = 1


#: Fixed values. The first three are the base kinds, in their order; runs are maximal, so a least length in the regex is the same as dropping short ones.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

#: A conjunction of trigrams; a query is a disjunction of these, None means that any text may match.
Clause = frozenset
MOST = 64


def _strings(node) -> list[str] | None:
    """All strings that a parsed regex can match, lower-cased, if they are few; else None."""
    out = [""]
    for op, arg in node:
        if op is C.LITERAL:
            some = [chr(arg).lower()]
        elif op is C.SUBPATTERN:
            some = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(b) for b in arg[1]]
            some = None if None in parts else [s for p in parts for s in p]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            some = [chr(a).lower() for _, a in arg]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
            one = _strings(arg[2])
            some = None if one is None else ["".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)]
        else:
            return None
        if some is None or len(out) * len(some) > MOST:
            return None
        out = [a + b for a in out for b in dict.fromkeys(some)]
    return list(dict.fromkeys(out))


def _either(strings: list[str]) -> list[Clause] | None:
    found = [Clause(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not all(found) else list(dict.fromkeys(found))


def _query(node) -> list[Clause] | None:
    """Trigrams that every match must hold: runs of exact strings are crossed, what breaks a run is a boundary."""
    out: list[Clause] | None = None
    run = [""]

    def also(more: list[Clause] | None) -> None:
        nonlocal out
        if more and (out is None or len(out) * len(more) <= MOST):
            out = more if out is None else list(dict.fromkeys(a | b for a in out for b in more))

    for op, arg in node:
        some = _strings([(op, arg)])
        if some is not None and len(run) * len(some) <= MOST:
            run = [a + b for a in run for b in some]
            continue
        also(_either(run))
        run = [""] if some is None else some
        if some is None and op is C.SUBPATTERN:
            also(_query(arg[3]))
        elif some is None and op is C.BRANCH:
            parts = [_query(b) for b in arg[1]]
            also(None if None in parts else [c for p in parts for c in p])
        elif some is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            also(_query(arg[2]))
    also(_either(run))
    return out


def trigram_query(regex: str) -> list[Clause] | None:
    """The Boolean query of a regex over lower-cased trigrams, as a disjunction of conjunctions; None: scan everything."""
    found = _query(parser.parse(regex))
    return found and [c for c in found if not any(d < c for d in found)]  # a clause that asks for more than another adds nothing


def trigram_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, id, row_hash) of those trigrams of the lower-cased texts that some rule asks for; others are never read."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return rows.select("id", "row_hash", F.explode(held).alias("trigram"))


#: A noncharacter that marks matches; if a text has it, it counts as another that no rule matches, of equal length.
_MARK, _OTHER = "\uffff", "\ufffe"


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """array<struct<start,rank,end,kind>> of the rule's leftmost non-overlapping matches, in code points."""
    parts = F.split(F.regexp_replace(text, F.lit(f"({rule.regex})"), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>").alias("out"))

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.char_length(part)
        good = F.char_length(part if not rule.keep else F.regexp_extract(part, rule.regex, rule.keep)) >= rule.least
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"] & good, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, begin, step, lambda a: a["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rules' spans in each whole text: the id and ``spans``, an array of (start, rank, end, kind) in that order: rank is the rule's place.

    One index of trigrams is written; each rule's Boolean query intersects its postings, and only the
    texts left are matched with its regex. Rules without mandatory trigrams match every text. A null
    text is empty; every input row gives one row (rows alike in id and text give the same), without spans an empty array.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    asked = {r.kind: trigram_query(r.regex) for r in rules}
    clauses = [(kind, i, t, len(c)) for kind, q in asked.items() if q for i, c in enumerate(q) for t in sorted(c)]
    none = F.array().cast("array<struct<start:long,rank:int,end:long,kind:string>>")
    if clauses:
        spark = docs.sparkSession
        index = stored(trigram_index(rows, sorted({c[2] for c in clauses})), "trigram-index", "trigram")
        need = spark.createDataFrame(clauses, "kind string, clause int, trigram string, need long")  # the rules' own, a few dozen rows
        hits = index.join(F.broadcast(need), "trigram").groupBy("kind", "clause", "id", "row_hash").agg(F.count_distinct("trigram").alias("n"), F.first("need").alias("need"))
        found = hits.where("n = need").groupBy("id", "row_hash").agg(F.collect_set("kind").alias("kinds")).withColumnsRenamed({"id": "c_id", "row_hash": "c_hash"})
        rows = rows.join(found, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("row_hash") == F.col("c_hash")), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    text = F.replace("text", F.lit(_MARK), F.lit(_OTHER))
    parts = [_spans(r, i, text) if not asked[r.kind] else F.when(F.array_contains("kinds", r.kind), _spans(r, i, text)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
