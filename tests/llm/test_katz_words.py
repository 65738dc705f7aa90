"""op1: words, their keys and the order of dealt bigrams, worked out for many at once."""

import numpy as np
import pyarrow as pa

from quillspark.llm import katz
from quillspark.llm.common import white_words

TEXTS = [b"", b"  ", b" a  B\x0bc\x0c\r\n", b"\xff\xfe A\xc3\x84 \xc3\xa4", " x y\x1cz    q".encode(), b"\x00a\x1f b", b"one two one"]


def test_words_are_those_of_the_contract():
    texts = pa.array(TEXTS, pa.binary())
    for a, b in ((0, 7), (2, 5), (0, 2), (3, 3), (6, 7)):
        keys, place, of = katz._tokens(texts.slice(a, b - a))
        want = [white_words(t) for t in TEXTS[a:b]]
        name = {int(katz._keys(pa.array([w], pa.binary()))[0]): w for ws in want for w in ws} | {katz.END: None}
        assert [name[int(keys[p])] for p in place] == [w for ws in want for w in (*ws, None)]
        assert of.tolist() == [i for i, ws in enumerate(want) for _ in (*ws, None)] and len(set(keys.tolist())) == len(keys)


def test_keys_of_words():
    words = [b"w" * n for n in range(1, 600)] + [b"%d" % i for i in range(20000)] + [b"w" * n + b"x" for n in range(1, 300)] + [b"a\x00", b"a\x00\x00"]
    keys = katz._keys(pa.array(words, pa.binary()))
    assert len(set(keys.tolist())) == len(words) and (keys & 1).all()
    mixed = pa.array([b"other", *words[::-1]], pa.binary()).slice(1)
    assert (katz._keys(mixed) == keys[::-1]).all() and not len(katz._keys(mixed.slice(0, 0)))


def test_packed_and_plain_order_are_the_same():
    rng = np.random.default_rng(3)
    cols = tuple(rng.integers(0, n, 5000) for n in (7, 30, 30, 9))
    for below in ((7, 30, 30, 9), (7, 1 << 30, 1 << 30, 9)):
        assert all((a == b[np.lexsort(cols[::-1])]).all() for a, b in zip(katz._sorted(cols, below), cols, strict=True))
