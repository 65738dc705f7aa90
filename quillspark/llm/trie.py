"""The prefix trie of conversations: adaptive radix trees over fixed-width turn ids, by ranges of sorted keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import art
from .common import arrow_rows, stored, text_of

#: Bytes of a turn's id: the first of its SHA-256, big-endian, so that keys sort as the ids do.
WIDTH = 16
#: Turns of a band: longer conversations are cut into keys of so many, each below the node where the one before ends.
BAND = 512
#: Keys of one tree, and bytes of them, at most (a record batch of so many rows more).
KEYS_A_TREE, BYTES_A_TREE, KEYS_A_BATCH = 1 << 14, 1 << 23, 1 << 10
#: Conversation ids that a block of a node's members spans.
IDS_A_BLOCK = 1 << 16
NODE_ROWS = 1 << 15
_NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = pa.schema([("chunk", pa.int64()), ("spine", pa.bool_()), ("id", pa.binary()), ("path", pa.list_(pa.binary())), ("band", pa.int32()), ("start", pa.binary()), ("top", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                  ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("chars", pa.int64())])
_OUT_DDL = "chunk long, spine boolean, id binary, path array<binary>, band int, start binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chars long"


def _short_hash(text: Column) -> Column:
    return F.unhex(F.left(F.sha2(text, 256), F.lit(2 * WIDTH)))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 in the order of turn, null first), turn_id and chars of each turn; null roles and texts are empty.

    Turns of a conversation that have the same number are ordered by turn_id. Rows with a null conv_id belong to none. Rows are sorted by ranges, so a
    conversation of any length is spread over tasks; what a task's first conversation has before it is added up from a row for each task.
    """
    role, text = text_of("role"), text_of("text")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _short_hash(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("turn_id"), F.char_length(text).cast("long").alias("chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(conv)) + 1)
            place = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                place[: starts[1] if len(starts) > 1 else None] += n
            last, n = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), batch.column("conv_id"), pa.array(place), batch.column("turn_id"), batch.column("chars")], names=["part", "conv_id", "place", "turn_id", "chars"])

    order = ("conv_id", F.col("turn").asc_nulls_first(), "turn_id")
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_id", "chars").mapInArrow(run, "part long, conv_id long, place long, turn_id binary, chars long")
    placed = stored(placed, "trie-turns")
    edges = placed.groupBy("part").agg(F.min("conv_id"), F.max(F.struct("conv_id", "place")))
    before, last, n = [], None, 0
    for part, first, (end, place) in sorted(edges.collect()):  # a row for each task of the sort
        carried = n if first == last else 0
        if carried:
            before.append((part, first, carried))
        last, n = end, place + 1 + (carried if first == end else 0)
    carry = placed.sparkSession.createDataFrame(before, "part long, conv_id long, n long")
    return placed.join(F.broadcast(carry), ["part", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("n", F.lit(0))).alias("pos"), "turn_id", "chars")


def with_borrowed_heads(turns: DataFrame, source: Column, n: Column, most: int, is_source: Column) -> DataFrame:
    """Numbered turns of rebuilt conversations: the first n turns (at most ``most``) of the conversation ``source``, both columns over
    conv_id, all if it has fewer, none if it has none; then the conversation's own turns from its nth on.

    ``is_source`` is true of conversations that may be a source. A conversation without borrowed turns gets one row with a null turn_id, so that it stays where it has no
    turns at all. A source's first turns are one row; it is joined to a row for each BAND of turns of those that borrow from it.
    """
    heads = turns.where(is_source & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("source")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("head"))
    band = F.expr(f"pos div {BAND}")
    marks = turns.where(F.col("pos") % BAND == 0).select("conv_id", band.alias("own_band"), n.alias("skipped"), source.alias("source")).join(heads, "source", "left")
    marks = marks.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("skipped").cast("int")))
    own = turns.withColumn("own_band", band).join(marks.select("conv_id", "own_band", "skipped", F.size("head").alias("got")), ["conv_id", "own_band"]).where("pos >= skipped")
    borrowed = marks.where("own_band = 0").select("conv_id", F.explode_outer("head").alias("x")).select("conv_id", "x.pos", "x.turn_id", "x.chars")
    return borrowed.unionByName(own.select("conv_id", (F.col("pos") - F.col("skipped") + F.col("got")).alias("pos"), "turn_id", "chars"))


def prefix_trie(turns: DataFrame, band_turns: int = BAND, keys_a_tree: int = KEYS_A_TREE) -> DataFrame:
    """A row for each distinct sequence of first turns of the conversations, from the textless root: conv_id (its smallest member), depth,
    parent_conv_id (the parent's conv_id; root: null), n_convs (members), n_children, n_leaves (childless nodes in its subtree),
    saved_tokens (summed over its subtree, each node's (n_convs - 1) times the characters of its last turn), ends_sha256 (SHA-256 of the ids of members
    that end there, ascending, comma-joined).

    ``turns``: conv_id, pos, turn_id, chars, as of ``numbered_turns``; rows with a null turn_id only say that the conversation is there.

    Conversations alike in all turns are one key with a count, so copies are counted before anything is sorted. Keys are sorted by ranges. A
    task builds an adaptive radix tree of each bounded run of its keys; nodes whose members all lie in a run are final, and only those on the paths of its first
    and last key, which other runs may share, are added up by their ids afterwards. Conversations of more than BAND turns are several keys: the deepest shared bands are built first,
    and give their sums to the nodes above. No conversations: no nodes. Very long texts are a hash and a length here; a repeated
    conversation id is one conversation, with all its rows as turns.
    """
    x = F.when(F.col("turn_id").isNotNull(), F.struct("pos", "turn_id", "chars"))
    banded = turns.groupBy("conv_id", F.coalesce(F.expr(f"pos div {band_turns}"), F.lit(0)).cast("int").alias("band")).agg(F.array_sort(F.collect_list(x)).alias("x"))
    banded = banded.withColumn("hexed", F.array_join(F.transform("x", lambda t: F.hex(t["turn_id"])), ""))
    banded = stored(banded.select("conv_id", "band", F.unhex("hexed").alias("key"), _short_hash(F.col("hexed")).alias("hash"), F.transform("x", lambda t: t["chars"]).alias("chars")), "trie-bands")
    deepest = banded.agg(F.max("band")).first()[0]
    if deepest is None:
        return turns.sparkSession.createDataFrame([], NODE)
    keys = stored(_keys(banded, deepest), "trie-keys")
    found, totals = None, None
    for i, band in enumerate(range(_shared(keys) if deepest else 0, -1, -1)):
        part = keys.where((F.col("band") == band) & (F.col("shared") | (F.col("band") == 0)))
        if i == 0 and deepest:
            part = part.unionByName(keys.where((F.col("band") > 0) & ~F.col("shared")))
        below = F.col("next").isNotNull()
        given = part.select("*", *[F.when(below, F.lit(v)).cast("long").alias(c) for c, v in (("x_children", 1), ("x_leaves", 1), ("x_saved", 0))])
        if totals is not None:
            sums = totals.select(F.col("start").alias("next"), *[F.col(c).alias(f"t_{c}") for c in ("n_children", "n_leaves", "saved_tokens")])
            given = given.join(sums, "next", "left").withColumns({"x_children": F.coalesce("t_n_children", "x_children"), "x_leaves": F.coalesce("t_n_leaves", "x_leaves"), "x_saved": F.coalesce("t_saved_tokens", "x_saved")})
        nodes = _nodes(given.select("band", "start", "key", "chars", "conv_id", "n", "ends", "first_conv", "x_children", "x_leaves", "x_saved"), band_turns, keys_a_tree)
        totals = nodes.where(F.col("top") & (F.col("band") == band))
        found = nodes if found is None else found.unionByName(nodes)
    return found.where("NOT (top AND band > 0)").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def _keys(banded: DataFrame, deepest: int) -> DataFrame:
    """The distinct keys of each band with the conversations that hold them: band, start (hash of the turns before the band), next (of all
    up to its end, where conversations go on), key, chars, conv_id, n, ends, shared (more than one conversation is in this part of the band), first_conv
    (the smallest that reaches the band's start)."""
    whole = banded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("band", "hash"))).alias("bands"))
    upto = lambda n: _short_hash(F.array_join(F.transform(F.slice("bands", F.lit(1), n), lambda b: F.hex(b["hash"])), ""))
    whole = whole.withColumn("whole", upto(F.size("bands")))
    if deepest:
        whole = stored(whole, "trie-conversations")
    ends = _ends(whole.select("conv_id", "whole"))
    some = whole.join(ends, "conv_id").select("conv_id", "n", "ends", "bands", F.explode(F.sequence(F.lit(1), F.size("bands"))).alias("at"))
    last = F.col("at") == F.size("bands")
    some = some.select("conv_id", (F.col("at") - 1).alias("band"), "n", F.when(last, F.col("ends")).alias("ends"), last.alias("last"), F.when(F.col("at") == 1, F.lit(b"")).otherwise(upto(F.col("at") - 1)).alias("start"), upto(F.col("at")).alias("next"))
    if deepest:
        on = some.where("NOT last").groupBy("band", "start", "next").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")).withColumns({"ends": F.lit(None).cast("string"), "last": F.lit(False)})
        some = stored(some.where("last").unionByName(on), "trie-parts")
        groups = some.where("band > 0").groupBy("band", "start").agg((F.sum("n") > 1).alias("shared"))
        # The first of a band's node has members that end there, too.
        first = some.groupBy((F.col("band") + 1).alias("band"), F.col("next").alias("start")).agg(F.min("conv_id").alias("first_conv"))
        some = some.join(groups.join(first, ["band", "start"]), ["band", "start"], "left")
    else:
        some = some.withColumns({"shared": F.lit(True), "first_conv": F.lit(None).cast("long")})
    some = some.withColumns({"shared": F.coalesce("shared", F.lit(True)), "next": F.when(~F.col("last"), F.col("next"))}).drop("last")
    return some.join(banded.drop("hash"), ["conv_id", "band"])


def _shared(keys: DataFrame) -> int:
    return keys.where("shared").agg(F.max("band")).first()[0]


def _ends(conversations: DataFrame) -> DataFrame:
    """Of conversations alike in all turns (whole) the smallest id, the number, and the hash of all ids: ids are joined by blocks of
    ranges of ids, and a group's blocks are hashed one after another in their order, so that no group is held as a whole."""
    blocks = conversations.groupBy("whole", F.floor(F.col("conv_id") / IDS_A_BLOCK).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("whole", "block", F.element_at("ids", 1).alias("conv_id"), F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rows, first, n, sha = None, [], 0, 0, None
        for batch in batches:
            for w, conv, some, joined in zip(*(batch.column(c).to_pylist() for c in ("whole", "conv_id", "n", "joined")), strict=True):
                if w == whole:
                    n += some
                    sha.update(b"," + joined.encode())
                    continue
                if whole is not None:
                    rows.append((first, n, sha.hexdigest()))
                whole, first, n, sha = w, conv, some, hashlib.sha256(joined.encode())
            if len(rows) > NODE_ROWS:
                yield _ends_rows(rows)
                rows = []
        if whole is not None:
            rows.append((first, n, sha.hexdigest()))
        yield _ends_rows(rows)

    return blocks.repartition("whole").sortWithinPartitions("whole", "block").select("whole", "conv_id", "n", "joined").mapInArrow(run, "conv_id long, n long, ends string")


def _ends_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["conv_id", "n", "ends"])


def _nodes(keys: DataFrame, band_turns: int, keys_a_tree: int) -> DataFrame:
    """Nodes of the keys, stored: those of NODE with band, start and top (the first of a band)."""
    order = ("band", "start", "key")
    with arrow_rows(keys.sparkSession, min(KEYS_A_BATCH, keys_a_tree)):
        part = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _trees(batches, band_turns, keys_a_tree), _OUT_DDL), "trie-nodes", "spine")
    spine = part.where("spine").groupBy("id").agg(
        F.any_value("path").alias("path"), F.max("band").alias("band"), F.any_value("start").alias("start"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("hanging"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends_sha256"), F.max("chars").alias("chars"))
    spine = stored(spine.withColumn("above", F.get("path", F.size("path") - 2)), "trie-spine")
    below = spine.where("above IS NOT NULL").groupBy(F.col("above").alias("id")).agg(F.count("*").alias("shared_children"))
    spine = spine.join(below, "id", "left").withColumn("n_children", F.col("hanging") + F.coalesce("shared_children", F.lit(0)))
    own = spine.select(F.explode("path").alias("id"), (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = own.groupBy("id").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = spine.select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    spine = stored(spine.drop("leaves", "saved").join(sums, "id").join(above, "above", "left").withColumn("top", F.size("path") == 1), "trie-spine")
    columns = ["band", "start", "top", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_run = part.where("spine").select("chunk", "id").join(spine.select("id", F.col("conv_id").alias("found")), "id")
    inner = part.where("NOT spine").join(of_run, ["chunk", "id"], "left").withColumn("parent_conv_id", F.coalesce("found", "parent_conv_id"))
    return stored(inner.select(columns).unionByName(spine.select(columns)), "trie-level")


def _trees(batches: Iterator[pa.RecordBatch], band_turns: int, keys_a_tree: int) -> Iterator[pa.RecordBatch]:
    """A tree of each run of sorted keys."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("key").nbytes
        if sum(b.num_rows for b in held) >= keys_a_tree or size >= BYTES_A_TREE:
            yield from _run(chunk, pa.Table.from_batches(held).combine_chunks(), band_turns)
            chunk, held, size = chunk + 1, [], 0
    if held:
        yield from _run(chunk, pa.Table.from_batches(held).combine_chunks(), band_turns)


def _run(chunk: int, table: pa.Table, band_turns: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    keys, bands, starts = (table.column(c).to_pylist() for c in ("key", "band", "start"))
    cuts = [0, *(i for i in range(1, len(keys)) if (bands[i], starts[i]) != (bands[i - 1], starts[i - 1])), len(keys)]
    rows: list[tuple] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        edges = ([keys[a]] if a == 0 else []) + ([keys[b - 1]] if b == len(keys) else [])
        for row in _tree_rows(Keys(table.slice(a, b - a), keys[a:b]), chunk, bands[a], bands[a] * band_turns, starts[a], edges):
            rows.append(row)
            if len(rows) >= NODE_ROWS:
                yield _batch(rows)
                rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


class Keys:
    """The distinct keys of one tree with what their rows say. A key of a whole band may have two rows: of those that end there and of those that go on."""

    def __init__(self, table: pa.Table, keys: list[bytes]):
        self.conv, self.n, self.ends, self.children, self.leaves, self.saved = (table.column(c).to_pylist() for c in ("conv_id", "n", "ends", "x_children", "x_leaves", "x_saved"))
        self.first = table.column("first_conv")[0].as_py()
        self.at = np.append(0, np.cumsum([len(k) // WIDTH for k in keys])).tolist()
        self.sums = np.append(0, np.cumsum(table.column("chars").combine_chunks().flatten().to_numpy(), dtype=np.int64)).tolist()
        self.keys = keys
        self.twice = [i for i in range(1, len(keys)) if keys[i] == keys[i - 1]]
        for i in self.twice:  # the row before gets all that this one says
            self.conv[i - 1], self.n[i - 1] = min(self.conv[i - 1], self.conv[i]), self.n[i - 1] + self.n[i]
            for values in (self.ends, self.children, self.leaves, self.saved):
                values[i - 1] = values[i] if values[i - 1] is None else values[i - 1]

    def chars(self, key: int, first: int, last: int) -> int:
        """Characters of a key's turns from the first to the last, counted from 1."""
        return self.sums[self.at[key] + last] - self.sums[self.at[key] + first - 1]


class Held:
    """What is known of a tree's node: members, the turn-aligned nodes right below it (heads), leaves and saved tokens below; on the
    paths of a run's edges the last three count only what hangs off these paths."""

    __slots__ = ("n", "conv", "heads", "leaves", "saved", "edge", "turn", "holder")

    def __init__(self):
        self.n, self.conv, self.heads, self.leaves, self.saved, self.edge, self.turn, self.holder = 0, None, 0, 0, 0, None, 0, None


def _tree_rows(held: Keys, chunk: int, band: int, depth: int, start: bytes, edges: list[bytes]) -> Iterator[tuple]:
    tree = art.Tree(held.keys)
    for i in sorted(set(range(len(held.keys))).difference(held.twice)):
        tree.insert(i)
    ids = []
    order = list(tree.walk())
    for node, _ in order:
        node.held = Held()
        node.held.turn = node.depth // WIDTH
    tree.root.held.conv = held.first
    for e, key in enumerate(edges):
        ids.append(_prefix_ids(band, start, key))
        for node in tree.path(key):
            node.held.edge = e
    for node, above in reversed(order):
        h = node.held
        i = node.end
        if i >= 0:
            h.n += held.n[i]
            h.conv = held.conv[i] if h.conv is None else min(h.conv, held.conv[i])
            if held.children[i] is not None:
                h.heads, h.leaves, h.saved = h.heads + held.children[i], h.leaves + held.leaves[i], h.saved + held.saved[i]
        if above is None:
            continue
        up, aligned = above.held, above.held.turn < h.turn
        up.n += h.n
        up.conv = h.conv if up.conv is None else min(up.conv, h.conv)
        if h.edge is None:
            h.leaves = h.leaves or 1
            up.heads += 1 if aligned else h.heads
            up.leaves += h.leaves
            up.saved += h.saved + ((h.n - 1) * held.chars(node.key, up.turn + 1, h.turn) if aligned else 0)
        elif not aligned:
            up.heads, up.leaves, up.saved = up.heads + h.heads, up.leaves + h.leaves, up.saved + h.saved
    for node, above in order:
        h = node.held
        turn = above.held.turn + 1 if above else 0
        if turn > h.turn:  # between two turns: what is below belongs to the node above
            h.holder = above.held.holder
            continue
        parent = above.held.holder if above else None
        h.holder = h
        for t in range(turn, h.turn + 1):
            deepest = t == h.turn
            ends = held.ends[node.end] if deepest and node.end >= 0 else None
            if h.edge is not None:
                path = ids[h.edge][: t + 1]
                sums = (h.heads, h.leaves, h.saved) if deepest else (0, 0, 0)
                yield (chunk, True, path[-1], path, band, start, t == 0, h.conv, depth + t, None, h.n, *sums, ends, held.chars(node.key, t, t) if t else 0)
            else:
                open_ = t == turn and parent is not None and parent.edge is not None
                up = None if open_ or t == 0 else (h.conv if t > turn else parent.conv)
                saved = h.saved + ((h.n - 1) * held.chars(node.key, max(t, 1), h.turn) if h.turn else 0)
                yield (chunk, False, ids[parent.edge][parent.turn] if open_ else None, None, band, start, t == 0, h.conv, depth + t, up, h.n, h.heads if deepest else 1, h.leaves, saved, ends, None)


def _prefix_ids(band: int, start: bytes, key: bytes) -> list[bytes]:
    """Ids of the nodes along a key: hashes of the band, what is before it, and each number of the key's first turns."""
    h = hashlib.blake2b(band.to_bytes(4) + len(start).to_bytes(1) + start, digest_size=16)
    found = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        found.append(h.digest())
    return found
