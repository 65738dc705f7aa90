"""Text blocks of scanned pages: boxes, labels, reading order, label-value pairs, triangulated totals."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_amount
from ..functions.extract import LABELS, block_amount, block_label, may_be_amount

BLOCK = ["document_id", "page", "pos"]


def flatten_ocr(raw: DataFrame) -> DataFrame:
    """raw (document_id, page, texts, scores, polygons: arrays; a polygon is points of (x, y) or one (x1, y1, x2, y2)) -> blocks.

    Blank texts are dropped, a missing score is 0; pos is the place in the arrays.
    """
    z = raw.select("document_id", "page", F.posexplode(F.arrays_zip("texts", "scores", "polygons")).alias("pos", "z"))
    p = F.col("z.polygons")
    xs, ys = F.transform(p, lambda q: F.get(q, 0)), F.transform(p, lambda q: F.get(q, 1))
    flat = (F.size(p) == 1) & (F.size(F.get(p, 0)) == 4)
    box = lambda i, axis, f: F.when(flat, F.get(F.get(p, 0), i)).when(F.size(p) >= 3, f(axis))
    df = z.select(
        *BLOCK, F.col("z.texts").alias("text"), F.coalesce("z.scores", F.lit(0.0)).alias("score"),
        box(0, xs, F.array_min).alias("x1"), box(1, ys, F.array_min).alias("y1"), box(2, xs, F.array_max).alias("x2"), box(3, ys, F.array_max).alias("y2"),
    )
    return df.where("trim(coalesce(text, '')) <> '' and x1 is not null")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns({"label": block_label(F.col("text")), "amount": block_amount(F.col("text"))})


def reading_order(blocks: DataFrame) -> DataFrame:
    """Each page's text in lines: a block joins the line while its middle is near that line's first block.

    The rule depends on each line's first block, so it is one pass over a page's blocks in order; pages are independent. A task
    holds one line and the text so far. Blocks without a box come first, each a line of its own; null pages are a page.
    """
    page = Window.partitionBy("document_id", "page")
    df = blocks.select("document_id", "page", ((F.col("y1") + F.col("y2")) / 2).cast("double").alias("cy"), F.col("x1").cast("double").alias("x1"), "pos", "text", F.avg(F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))).over(page).alias("h"))
    df = df.select("document_id", "page", "cy", "x1", "pos", "text", F.greatest(F.lit(8.0), 0.6 * F.col("h")).alias("near"))
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return df.sortWithinPartitions("document_id", "page", "cy", "x1", "pos", "text").mapInArrow(_lines, f"document_id {types['document_id']}, page {types['page']}, text string")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, anchor, line, lines, done = None, None, [], [], []

    def ended() -> None:
        if line:
            lines.append(" ".join(w[2] for w in sorted(line, key=lambda w: (w[0] is not None, w[0] or 0.0, w[1])) if w[2] is not None))

    for batch in batches:
        for doc, page, cy, x1, pos, text, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != (doc, page):
                if here is not None:
                    ended()
                    done.append((*here, "\n".join(lines)))
                here, anchor, line, lines = (doc, page), None, [], []
            if not (anchor is not None and cy is not None and abs(cy - anchor) <= near):
                ended()
                line, anchor = [], cy
            line.append((x1, pos, text))
        if len(done) > 1000:
            yield _pages(done, batch)
            done = []
    if here is not None:
        ended()
        done.append((*here, "\n".join(lines)))
        yield _pages(done, batch)


def _pages(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    types = [like.schema.field(0).type, like.schema.field(1).type, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["document_id", "page", "text"])


def pair_candidates(blocks: DataFrame) -> DataFrame:
    """Values for each label, best first: the nearest to its right in the row, else the nearest below in its column."""
    return _paired(blocks, False)


def _dealt(blocks: DataFrame, *by: str, paired: Column | None = None) -> DataFrame:
    """Blocks, classified once and dealt once by a hash of these columns, in order of the hash. Where paired is not true a block is only kept if it may be an amount.

    Which may be is told by their start: a filter by the amount itself would be worked out once more below, with all that the text is made of."""
    b = blocks.where("pos is not null")
    if paired is None:
        b, other = classify_blocks(b), F.col("label").isNull()
    else:
        b = b.where(F.coalesce(paired, F.lit(False)) | may_be_amount(F.col("text")))
        b, other = b.withColumns({"label": F.when(paired, block_label(F.col("text"))), "amount": block_amount(F.col("text"))}), paired & F.col("label").isNull()
    code = F.coalesce(*[F.when(F.col("label") == n, F.lit(i)) for i, n in enumerate(LABELS)], F.lit(-1))
    value = F.coalesce("amount", F.when(other, F.trim("text")))
    b = b.select("document_id", "page", "pos", code.alias("code"), F.col("amount").isNotNull().alias("money"), value.alias("value"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.xxhash64(*by).alias("h"))
    return b.repartition("h").sortWithinPartitions("h")


def _paired(blocks: DataFrame, best: bool) -> DataFrame:
    """The candidates, or only each label's best one; a task holds some whole pages at a time."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = f"document_id {types['document_id']}, page {types['page']}, l_pos {types['pos']}, code int, v_pos {types['pos']}, value string, way int, cost double, rank int"
    df = _dealt(blocks, "document_id", "page").mapInArrow(functools.partial(_pairs, best=best), schema)
    return df.select("document_id", "page", "l_pos", F.element_at(F.array(*map(F.lit, LABELS)), F.col("code") + 1).alias("field_name"), "v_pos", "value", "way", "cost", "rank")


#: Rows that a task holds, if a page has no more, and pairs that it looks at together.
_HELD, _TOGETHER = 1 << 16, 1 << 20


def _numbered(t: pa.Table, *cols: str) -> np.ndarray:
    """Numbers of the runs of rows alike in hash and these columns. Nulls are alike."""
    h = t.column("h").to_numpy()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    for c in (t.column(n).combine_chunks() for n in cols):
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.cumsum(new)


def _in_order(t: pa.Table, *cols: str) -> tuple[pa.Table, np.ndarray]:
    """Rows in order of hash and these columns, with a number for each group of them. Rows come by hash: only groups of one hash may be mixed, nulls come first."""
    group = _numbered(t, *cols)
    if group[-1] > _numbered(t)[-1]:
        t = t.take(pc.sort_indices(t, [("h", "ascending"), *((c, "ascending") for c in cols)], null_placement="at_start"))
        group = _numbered(t, *cols)
    return t, group


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of some whole hashes at a time."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if last and rows + last >= _HELD:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, rows, batch = [], 0, batch.slice(last)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _near(c: np.ndarray, by: np.ndarray, page: np.ndarray, lab: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(label, value) of one page whose c are at most by apart, and a few that are just farther; values are in order of (page, c)."""
    by = by + 1e-9 * (np.abs(c[lab]) + by)
    lab, by = lab[~np.isnan(by)], by[~np.isnan(by)]
    kind = np.repeat([1, 0, 2], [len(values), len(lab), len(lab)])
    order = np.lexsort((kind, np.concatenate([c[values], c[lab] - by, c[lab] + by]), np.concatenate([page[values], page[lab], page[lab]])))
    upto = np.empty(len(order), np.int64)
    upto[order] = np.cumsum(kind[order] == 1)
    low, high = upto[len(values) :].reshape(2, -1)
    end = np.cumsum(high - low)
    at = 0
    while at < len(lab):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + _TOGETHER, "right")))
        n = (high - low)[at:to]
        yield np.repeat(lab[at:to], n), values[np.arange(end[to - 1] - done) - np.repeat(np.cumsum(n) - n - low[at:to], n)]
        at = to


def _of_pages(t: pa.Table, page: np.ndarray, best: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Of pages in order the candidates (label, value, way, cost, rank), ranked. Labels look for values between two places of their page's blocks sorted by cy, then by cx."""
    x1, y1, x2, y2, pos, code, money = (t.column(n).to_numpy() for n in ("x1", "y1", "x2", "y2", "pos", "code", "money"))
    word = pc.fill_null(pc.not_equal(t.column("value").combine_chunks(), ""), False).to_numpy(zero_copy_only=False) & (code < 0)
    cy, cx, h, w = (y1 + y2) / 2, (x1 + x2) / 2, np.fmax(y2 - y1, 1.0), np.fmax(x2 - x1, 1.0)
    of_money = (code >= 0) & (code < 3)
    reach = np.where(of_money, np.fmax(3 * w, 6 * h), np.fmax(2 * w, 4 * h))
    labels, values = np.flatnonzero(code >= 0), np.flatnonzero(money | word)
    by_y, by_x = (s[np.lexsort((c[s], page[s]))] for c in (cy, cx) for s in (values[~np.isnan(c[values])],))

    def beside(lab: np.ndarray, way: int) -> Iterator[tuple[np.ndarray, ...]]:
        for a, v in _near(cy, 0.9 * h[lab], page, lab, by_y) if way == 0 else _near(cx, reach[lab], page, lab, by_x):
            fits = (pos[a] != pos[v]) & np.where(of_money[a], money[v], word[v])
            a, v = a[fits], v[fits]
            dy, edge = np.abs(cy[v] - cy[a]), x2[a] - 0.25 * w[a]
            if way == 0:
                fits = (dy <= 0.9 * h[a]) & (x1[v] >= edge)
                cost = x1[v] - x2[a]
            else:
                dx = np.abs(cx[v] - cx[a])
                fits = ((dy > 0.9 * h[a]) | (x1[v] < edge)) & (y1[v] >= y2[a] - 0.225 * h[a]) & (dx <= reach[a])
                cost = y1[v] - y2[a] + 0.25 * dx
            yield a[fits], v[fits], np.full(fits.sum(), way, np.int32), cost[fits]

    def ranked(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, v, way, cost = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((pos[v], cost, way, pos[a], page[a]))
        a, v, way, cost = a[order], v[order], way[order], cost[order]
        first = np.ones(len(a), bool)
        first[1:] = (page[a][1:] != page[a][:-1]) | (pos[a][1:] != pos[a][:-1])
        rank = np.arange(1, len(a) + 1) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(a) else np.zeros(0, np.int64)
        return tuple(c[rank == 1] for c in (a, v, way, cost, rank)) if best else (a, v, way, cost, rank)

    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
    for some in [labels] if best else np.split(labels, range(1024, len(labels), 1024)):
        found = none
        for way in (0, 1):
            lab = np.setdiff1d(some, found[0]) if best else some
            for more in beside(lab, way):
                found = ranked([found[:4], more])[:4] if best else tuple(map(np.concatenate, zip(found, more, strict=True)))
        yield ranked([found])


def _pairs(batches: Iterator[pa.RecordBatch], best: bool) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches):
        t, page = _in_order(t, "document_id", "page")
        for a, v, way, cost, rank in _of_pages(t, page, best):
            if len(a):
                ids = [t.column(n).take(a).combine_chunks() for n in ("document_id", "page", "pos", "code")]
                cols = [*ids, t.column("pos").take(v).combine_chunks(), t.column("value").take(v).combine_chunks(), pa.array(way), pa.array(cost), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["document_id", "page", "l_pos", "code", "v_pos", "value", "way", "cost", "rank"])


def _claims(t: pa.Table, page: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, value) of documents in order, of their pages in order: labels take their best value, the first one first; a value taken, or a field filled, is skipped.

    In each round every document's first label that is left takes its value, and those in its way go: there are as many rounds as fields at most.
    """
    pos, code = t.column("pos").to_numpy(), t.column("code").to_numpy()
    ((a, v, *_),) = _of_pages(t, page, True)
    d, field = doc[a], code[a]
    _, at = np.unique(pos[v], return_inverse=True)
    place = page[a] * (at.max(initial=0) + 1) + at
    alone = t.column("page").is_null().combine_chunks().to_numpy(zero_copy_only=False)[a]
    place[alone] = -1 - np.flatnonzero(alone)  # an unknown page is like no other
    left, kept = np.arange(len(a)), []
    while len(left):
        new = np.append(True, d[left[1:]] != d[left[:-1]])
        kept.append(left[new])
        of = left[new][np.cumsum(new) - 1]
        left = left[(field[left] != field[of]) & (place[left] != place[of])]
    kept = np.concatenate([left, *kept])
    return a[kept], v[kept]


def _claimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(list(LABELS))
    for t in _whole(batches):
        t, page = _in_order(t, "document_id", "page")
        a, v = _claims(t, page, _numbered(t, "document_id"))
        cols = [t.column("document_id").take(a).combine_chunks(), names.take(t.column("code").take(a).combine_chunks()), t.column("value").take(v).combine_chunks()]
        yield pa.RecordBatch.from_arrays(cols, names=["document_id", "field_name", "value"])


def pair_labels(blocks: DataFrame) -> DataFrame:
    """Fields by layout. Labels take their best value in block order; a value taken, or a field filled, is skipped. A task holds some whole documents at a time."""
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    return _dealt(blocks, "document_id").mapInArrow(_claimed, f"document_id {types['document_id']}, field_name string, value string")


#: Amounts of a document that are looked at in a matrix of many documents, and how far a sum may be off, in millionths.
_FEW, _OFF = 12, 20_000


def _triangles(doc: np.ndarray, values: pa.Array, pos: np.ndarray) -> np.ndarray:
    """Rows of (total, subtotal, tax) of each document that has them: a search for total - subtotal, largest ones first.

    doc: numbers in order; values: decimals of six places. Documents with as many distinct amounts are one matrix; those with many
    amounts, or with amounts beyond 64 bits, are searched by themselves.
    """
    raw = np.frombuffer(values.buffers()[1], np.int64)[2 * values.offset : 2 * (values.offset + len(values))].reshape(-1, 2) if len(values) else np.zeros((0, 2), np.int64)
    low, high = raw[:, 0], raw[:, 1]
    fits = (high == 0) & (low >= 0) & (low < 1 << 62)
    good = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False) & (high >= 0) & ((high > 0) | (low != 0)))
    order = good[np.lexsort((pos[good], low[good].view(np.uint64), high[good], doc[good]))]
    new = np.ones(len(order), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (raw[order[1:]] != raw[order[:-1]]).any(1)
    order = order[new]
    start = np.flatnonzero(np.append(True, doc[order[1:]] != doc[order[:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(order)))
    wide = np.zeros(len(start), bool)
    wide[np.searchsorted(start, np.flatnonzero(~fits[order]), "right") - 1] = True
    alone, out = (size >= 3) & (wide | (size > _FEW)), []
    for n in np.unique(size[(size >= 3) & ~alone]).tolist():
        at = order[start[(size == n) & ~alone][:, None] + np.arange(n)]
        v, p, best = low[at], pos[at], np.full((len(at), 3), -1)
        for t in range(n - 1, 0, -1):
            for s in range(t - 1, -1, -1):
                near = np.abs(v[:, :t] - (v[:, t] - v[:, s])[:, None]) <= _OFF
                hit = np.flatnonzero(near.any(1) & (best[:, 0] < 0))
                tax = np.where(near[hit], p[hit, :t], np.iinfo(np.int64).max).argmin(1)
                best[hit] = np.stack([np.full(len(hit), t), np.full(len(hit), s), tax], 1)
        done = best[:, 0] >= 0
        out.append(np.take_along_axis(at[done], best[done], 1))
    for i, n in zip(start[alone].tolist(), size[alone].tolist(), strict=True):
        rows = order[i : i + n]
        best = _search([(int(h) << 64) + int(x) for h, x in zip(high[rows], low[rows].view(np.uint64), strict=True)], pos[rows])
        out += [rows[[best]]] if best else []
    return np.concatenate([np.zeros((0, 3), np.int64), *out])


def _search(units: list[int], pos: np.ndarray) -> list[int] | None:
    """Of sorted distinct amounts the places of total, subtotal and tax."""
    v = np.array(units, np.int64 if units[-1] < 1 << 62 else object)
    for t in range(len(v) - 1, 0, -1):
        low = np.searchsorted(v, v[t] - v[:t] - _OFF)
        high = np.minimum(t, np.searchsorted(v, v[t] - v[:t] + _OFF, "right"))
        if (low < high).any():
            s = int(np.flatnonzero(low < high)[-1])
            return [t, s, int(low[s]) + int(np.argmin(pos[low[s] : high[s]]))]
    return None


_TRIANGLE = ("total", "subtotal", "tax")


def _triangulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches):
        t, doc = _in_order(t, "document_id")
        v, pos = t.column("v").combine_chunks(), t.column("pos").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        rows = _triangles(doc, v, pos)
        yield pa.RecordBatch.from_arrays([t.column("document_id").take(rows[:, 0]).combine_chunks(), *[v.take(pa.array(r)) for r in rows.T]], names=["document_id", *_TRIANGLE])


def _document_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches):
        t, page = _in_order(t, "document_id", "page")
        doc = _numbered(t, "document_id")
        last = np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(doc) - 1)  # document n is at place n - 1
        a, v = _claims(t, page, doc)
        code, values, amounts = t.column("code").to_numpy()[a], t.column("value").combine_chunks(), t.column("v").combine_chunks()
        cols = [t.column("document_id").take(last).combine_chunks()]

        def placed(from_: pa.Array, rows: np.ndarray) -> pa.Array:
            place = np.full(len(last), -1)
            place[doc[rows[0]] - 1] = rows[1]
            return from_.take(pa.array(place, mask=place < 0))

        cols += [placed(values, np.stack([a, v])[:, code == i]) for i in range(len(LABELS))]
        money = np.flatnonzero(amounts.is_valid().to_numpy(zero_copy_only=False))
        found = money[_triangles(doc[money], amounts.take(pa.array(money)), t.column("pos").to_numpy().astype(np.int64)[money])]
        cols += [placed(amounts, np.stack([found[:, 0], r])) for r in found.T]
        yield pa.RecordBatch.from_arrays(cols, names=["document_id", *LABELS, *(f"found_{n}" for n in _TRIANGLE)])


def document_fields(blocks: DataFrame, paired: Column | None = None) -> DataFrame:
    """Per document its fields by layout, a column each, as in pair_labels, and found_total, found_subtotal and found_tax, as in triangulate.

    Blocks are classified and dealt once for both; a task holds some whole documents at a time. With paired (over columns of the blocks) labels of other
    blocks are not looked at; all amounts are.
    """
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    b = _dealt(blocks, "document_id", paired=paired)
    b = b.withColumn("v", F.when(F.col("money"), parse_amount(F.col("value"))))
    return b.mapInArrow(_document_fields, ", ".join([f"document_id {types['document_id']}", *(f"{n} string" for n in LABELS), *(f"found_{n} decimal(38,6)" for n in _TRIANGLE)]))


def filled(text: Column, amount: Column) -> Column:
    """A known amount's text, or the amount found for it."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), amount.cast("decimal(38,2)").cast("string"))


def triangulate(amounts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """amounts (document_id, pos, value): total, subtotal and tax of documents with three distinct positive amounts or more,
    where total - subtotal is within .02 of a smaller amount: the largest total wins, then subtotal, then the first tax.

    With known (document_id, total_amount, subtotal, tax) only missing fields are filled: a row per known document.
    """
    types = {f.name: f.dataType.simpleString() for f in amounts.schema}
    a = amounts.select("document_id", F.col("pos").cast("long").alias("pos"), parse_amount(F.col("value")).alias("v"), F.xxhash64("document_id").alias("h"))
    found = a.repartition("h").sortWithinPartitions("h").mapInArrow(_triangulated, f"document_id {types['document_id']}, total decimal(38,6), subtotal decimal(38,6), tax decimal(38,6)")
    if known is None:
        return found
    names = {"total_amount": "total", "subtotal": "subtotal", "tax": "tax"}
    have = known.select("document_id", *[F.col(c).alias(f"known_{c}") for c in names])
    return have.join(found, "document_id", "left").select("document_id", *[filled(F.col(f"known_{c}"), F.col(n)).alias(c) for c, n in names.items()])
