"""N-best SentencePiece segmentation: backward A-star over the piece lattice, with forward Viterbi scores as exact heuristics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, coded, gathered, joined_bytes, slices, sums_before, text_of

Path = tuple[float, tuple[int, ...]]
NEVER = float("-inf")


def log_probabilities(scores: dict[int, float]) -> dict[int, float]:
    """What a segmentation sums up, by piece id: a unigram model's scores as they are.

    A BPE model has merge ranks (0, -1, -2, ...) instead, which are no log probabilities: their sum would prefer many
    early pieces to a few late ones. Its pieces get Zipf's law over the order of their merges: the r-th has ln(1 / (r H)), H such
    that all sum to 1. Nothing is trained.
    """
    if any(s != int(s) for s in scores.values()):
        return scores
    order = sorted(scores, key=lambda i: (-scores[i], i))
    norm = np.log(np.sum(1 / np.arange(1, len(order) + 1)))
    return {i: float(-np.log(r) - norm) for r, i in enumerate(order, 1)}


class Pieces:
    """A model's pieces with their log probabilities. Spaces stand for the model's space mark, so the mark itself is a character like others.

    A character that is no piece takes its UTF-8 bytes' pieces, at the least score minus ten. A text is cut between two
    characters that no piece holds side by side (such as before a space after a letter, around a line end): the
    cuts' best segmentations make up the text's. Each distinct segment of a batch is looked up or searched once.
    """

    KEPT = 200_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        known = {i: sp.id_to_piece(i).replace("▁", " ") for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        worth = log_probabilities({i: sp.get_score(i) for i in known})
        self.scores = {p: (i, worth[i]) for i, p in known.items()}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        out = [b""] * len(ids)
        for p, (i, _) in self.scores.items():
            out[i] = p.encode()
        for b, i in self.byte_id.items():
            out[i] = bytes([b])
        self.out_sizes = np.array([len(x) for x in out], dtype=np.int64)
        self.out_first, self.out_bytes = sums_before(self.out_sizes)[:-1], np.frombuffer(b"".join(out), np.uint8)
        self.missing = min(s for _, s in self.scores.values()) - 10
        self.trie: dict = {}
        for p, found in self.scores.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = found
        # Whether some piece holds a character with this last byte just before one with that first byte.
        self.inside = np.zeros((256, 256), dtype=bool)
        for p in self.scores:
            for x, y in zip(p, p[1:], strict=False):
                self.inside[x.encode()[-1], y.encode()[0]] = True
        self.kept, self.kept_best = Kept(self.KEPT), Kept(self.KEPT)

    def forward(self, text: str) -> tuple[list[float], list[float], list[list[tuple[int, float, int | None]]], list[int]]:
        """Of each place: the best score up to it, the second best, the lattice's edges into it (start, score, id; None for bytes), and which is best."""
        n, missing, trie, scores = len(text), self.missing, self.trie, self.scores
        best, second, last = [0.0] + [NEVER] * n, [NEVER] * (n + 1), [0] * (n + 1)
        into: list[list] = [[] for _ in range(n + 1)]
        for start in range(n):
            x0, y0, node = best[start], second[start], trie
            edges = []
            for end in range(start, n):
                node = node.get(text[end])
                if node is None:
                    break
                found = node.get("")
                if found is not None:
                    edges.append((end + 1, found[1], found[0]))
            if text[start] not in scores:
                edges.append((start + 1, missing, None))
            for e, s, i in edges:
                x, y, b = x0 + s, y0 + s, best[e]
                if x > b:
                    second[e] = b if b > y else y
                    best[e], last[e] = x, len(into[e])
                elif x > second[e]:
                    second[e] = x
                into[e].append((start, s, i))
        return best, second, into, last

    def ids_of(self, text: str, start: int, piece: int | None) -> tuple[int, ...]:
        return (piece,) if piece is not None else tuple(self.byte_id[b] for b in text[start].encode())

    def nbest(self, text: str, n: int) -> list[Path]:
        """The n best segmentations by A-star from the end: a hypothesis ranks by its score so far and the best score of what is left.

        With exact heuristics each hypothesis stands for a whole path of its score, so the agenda needs no more
        hypotheses than paths are still wanted; among equals the one nearest to the start goes first.
        """
        best, _, into, _ = self.forward(text)
        agenda: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
        out: list[Path] = []
        made = 0
        while agenda and len(out) < n:
            down, end, _, g, tail = agenda.pop(0)
            if end == 0:
                ids: list[int] = []
                while tail:
                    ids += self.ids_of(text, *tail[0])
                    tail = tail[1]
                out.append((-down, tuple(ids)))
                continue
            for start, score, piece in into[end]:
                made += 1
                agenda.append((-(g + score + best[start]), start, made, g + score, ((start, piece), tail)))
            agenda = sorted(agenda)[: n - len(out)]
        return out

    def _make(self, segments: list[bytes]) -> list[tuple[bytes, float, float]]:
        """(ids, score, how much the second best loses) of new segments."""
        out = []
        for s in segments:
            text = s.decode()
            best, second, into, last = self.forward(text)
            ids, end = [], len(text)
            while end:
                start, _, piece = into[end][last[end]]
                ids += reversed(self.ids_of(text, start, piece))
                end = start
            out.append((np.array(ids[::-1], dtype="<i4").tobytes(), best[-1], best[-1] - second[-1]))
        return out

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places where a segment begins: the texts' own beginnings, and before characters that no piece joins to the one before."""
        before = np.concatenate([data[:1], data])[: len(data)]
        mask = ((data & 0xC0) != 0x80) & ~self.inside[before, data]
        mask[at[:-1]] = True
        return np.flatnonzero(mask)

    def encode(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Ids of the best segmentations of all texts behind each other, where each text's begin (with the end of all), and each
        text's n best as (score, changes to the best as (place, ids there, ids instead)).

        The n best of a text differ from the best in the n - 1 segments whose second best loses least, so only these
        are searched, and their n best combined.
        """
        # A text without characters has no segment: the space before each text is only for the others.
        some = np.flatnonzero(np.array([len(t) > 0 for t in texts.to_pylist()], dtype=bool))
        data, at = joined_bytes(texts.take(pa.array(some)), b" ")
        cuts = self.cuts(data, at)
        codes, segments = coded(data, cuts)
        found = self.kept.take(segments, self._make)
        parts = [x[0] for x in found]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        scores, gaps = (np.array([x[k] for x in found], dtype=float)[codes] for k in (1, 2))
        ids = gathered(np.frombuffer(b"".join(parts), "<i4"), sums_before(sizes)[:-1][codes], sizes[codes])
        place, first = sums_before(sizes[codes]), np.searchsorted(cuts, at)
        totals = np.add.reduceat(scores, first[:-1]) if len(some) else np.zeros(0)
        near = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            g = gaps[a:z]
            pick = np.argpartition(g, n - 2)[: n - 1] if len(g) >= n > 1 else np.arange(len(g))[: n - 1]
            near.append([a + k for k in sorted(pick[np.isfinite(g[pick])].tolist())])
        searched = sorted({int(codes[k]) for ks in near for k in ks})
        options = dict(zip(searched, self.kept_best.take([segments[c] for c in searched], lambda new: [(n, self.nbest(s.decode(), n)) for s in new]), strict=True))
        out = []
        for total, a, ks in zip(totals.tolist(), first[:-1].tolist(), near, strict=True):
            combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            found_of = [options[int(codes[k])] for k in ks]
            found_of = [o if m == n else self.nbest(segments[codes[k]].decode(), n) for k, (m, o) in zip(ks, found_of, strict=True)]
            for o in found_of:
                combos = sorted((loss + o[0][0] - x, (*pick, i)) for loss, pick in combos for i, (x, _) in enumerate(o))[:n]
            out.append([(total - loss, [(int(place[k] - place[a]), int(sizes[codes[k]]), o[i][1]) for k, o, i in zip(ks, found_of, pick, strict=True) if i]) for loss, pick in combos])
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        starts[some + 1] = np.diff(place[first])
        nbest: list = [[(0.0, [])]] * len(texts)
        for i, x in zip(some.tolist(), out, strict=True):
            nbest[i] = x
        return ids, np.cumsum(starts), nbest

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, a space before each text included."""
        return gathered(self.out_bytes, self.out_first[ids], self.out_sizes[ids])


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """One model per worker process; what it keeps serves later tasks too."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


_NBEST = "array<struct<score:double,changes:array<struct<at:int,n:int,ids:array<int>>>>>"


def encode(docs: DataFrame, model: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segment whole texts: the id, ``ids`` (best segmentation, 32-bit little-endian), ``n_tokens``, ``score``, ``nbest``
    (scores, and changes that turn the best into each) and ``text_back`` (whether decoding ``ids`` gives the text).

    A null or empty text has no ids and one empty segmentation of score 0. Every input row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces_of(model)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        for batch in slices(batches, most=4 << 20):
            ids, at, found = m.encode(batch.column(1), n)
            nbest = [[{"score": s, "changes": [{"at": a, "n": k, "ids": x} for a, k, x in c]} for s, c in f] for f in found]
            each = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            back = [m.decode(x).tobytes()[1:] == t.encode() for x, t in zip(each, batch.column(1).to_pylist(), strict=True)]
            each = [x.tobytes() for x in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(each, pa.binary()), pa.array(np.diff(at)), pa.array([f[0][0] for f in found], pa.float64()), pa.array(nbest, kind), pa.array(back, pa.bool_()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                names=["id", "ids", "n_tokens", "score", "nbest", "text_back", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, n_tokens long, score double, nbest {_NBEST}, text_back boolean, ids_crc32 long").withColumnRenamed("id", id_col)
