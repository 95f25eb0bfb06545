"""The blocks of the exact vector search."""

import tracemalloc

import numpy as np
import pyarrow as pa

from siftstone.operators import dense


def test_dense_blocks_hold_a_bounded_number_of_scores(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (3000, 8)).astype(float)  # many ties
    rows = lambda name, at: pa.table([pa.array(at), pa.array(list(x[at]))], [name, "vector"])
    every, asked = np.arange(len(x)), np.arange(0, len(x), 3)
    tracemalloc.start()
    monkeypatch.setattr(dense, "SCORES", 1 << 16, raising=False)
    found = dense._block_topk(5, 6)(rows("chunk_id", every), rows("query_id", asked)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000  # all 3,000,000 scores are 24 MB
    length = np.linalg.norm(x, axis=1)
    for q in (n for n in asked[::50] if length[n]):
        scores = [(-(round(float(x[q] @ x[c] / length[q] / length[c]), 6) + 0.0), c) for c in every if length[c]]
        got = found[found.query_id == q].sort_values(["score", "chunk_id"], ascending=[False, True])
        assert got.chunk_id.tolist() == [c for _, c in sorted(scores)[:5]]
