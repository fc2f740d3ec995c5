"""What a task holds: few texts as Python strings at a time, few pairs of vectors."""

import unicodedata

import numpy as np
import pyarrow as pa

from mergewell.functions import text
from mergewell.operators import search


def test_texts_are_normalized_a_few_at_a_time():
    texts = pa.array([None, "", "é" * 400_000, "a", None, "ﬁ" * 400_000, "b"])
    parts = list(text._normalized(texts, "NFKD"))
    assert len(parts) > 1 and max(p.nbytes for p in parts) < 3 * text.AT_ONCE
    assert pa.concat_arrays(parts).to_pylist() == [s and unicodedata.normalize("NFKD", s) for s in texts.to_pylist()]


def test_queries_of_a_block_are_dealt_to_several_tasks(spark, monkeypatch):
    """One block, which all queries visit."""
    v = np.random.default_rng(3).normal(size=(9000, 8)).astype(np.float32)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<float>")
    held, met = [], search.met
    monkeypatch.setattr(search, "met", lambda a, b, key, groups: held.append((groups, max(r["count"] for r in a.groupBy(*key).count().collect()))) or met(a, b, key, groups))
    found = {r["id"]: r["match_id"] for r in search.search(rows, rows, exclude_self=True, pivots=4, same=True).collect()}
    assert held[0][0] >= 4 and all(most < 3000 for _, most in held)
    u = v.astype(np.float64) / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    for k in range(0, 9000, 500):
        s = u @ u[k]
        s[k] = -2
        assert s[found[k]] > s.max() - 1e-6
