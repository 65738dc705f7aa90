"""op1: what a task holds at once doesn't grow with the corpus."""

import numpy as np
import pandas as pd
import pyarrow as pa

from quillspark.llm import katz


def test_stored_arrays_are_short():
    """The reader decodes 4,096 rows at once: with all their members they are far from a row group."""
    n = 10_000
    pdf = katz._frame("counts", h=np.arange(n), n=np.arange(n) + 1, known=np.arange(n) + 2)
    batches = list(katz._arrays(pdf))
    table = pa.Table.from_batches(batches)
    sizes = [len(x) for x in table.column("h").to_pylist()]
    assert max(sizes) * 4096 <= 1 << 18 and sum(sizes) == n and len(batches) < len(sizes) / 10
    for c, first in (("h", 0), ("n", 1), ("known", 2)):
        assert [v for x in table.column(c).to_pylist() for v in x] == list(range(first, first + n))
    assert table.column("doc_id").null_count == table.num_rows and set(table.column("kind").to_pylist()) == {"counts"}
    assert not list(katz._arrays(pdf.iloc[:0]))


def test_a_bucket_is_settled_with_the_texts_of_a_few_parts(monkeypatch):
    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in range(30)]
    keys = np.sort(katz._keys(pa.array(words[:20], pa.binary())))
    known = katz.Known(np.append(np.int64(katz.END), keys)[np.argsort(np.append(np.int64(katz.END), keys))], np.arange(21) % 6 + 1, 100, 31, 40, katz.good_turing({}), 0.01, 1.0, np.zeros(0, np.int64), np.zeros((1, 0), np.int64))
    parts = [pd.DataFrame({"doc_id": np.arange(20) + 20 * p, "tag": 0, "held": [i % 4 == 1 for i in range(20)], "text": [b" ".join(rng.choice(words, 9)) for _ in range(20)]}) for p in range(5)]
    payloads = [x for part in parts for x in katz._deal(known, 1, part).query("kind == 'bigrams'")["payload"]]
    held, plain = [], katz._settle
    monkeypatch.setattr(katz, "_settle", lambda known, ids, *a: (held.append(len(ids)), plain(known, ids, *a))[1])

    def settled():
        found = pd.concat(katz._meet(known, payloads))
        found = found[found["kind"].isin(["text", "back"])].drop(columns=["payload"])
        return found.groupby(["kind", "doc_id", "tag", "h"]).sum(numeric_only=True).round(9)

    whole = settled()
    assert held == [100]
    monkeypatch.setattr(katz, "SETTLED", 1)
    held.clear()
    pd.testing.assert_frame_equal(settled(), whole)
    assert held == [20] * 5
