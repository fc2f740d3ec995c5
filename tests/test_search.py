"""The search by bounds against all pairs, and how many pairs it looks at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergewell.operators import search

SCHEMA = "id long, vector array<float>, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(int(k), None if v is None else [None if x is None else float(x) for x in v], "x") for k, v in rows], SCHEMA).repartition(3)


def unit(v):
    m = np.array(v, np.float32).astype(np.float64)
    length = np.sqrt((m * m).sum())
    return (m / length if length else m).astype(np.float32).astype(np.float64)


def plain(queries, catalog, exclude_self=False):
    usable = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    others = [(k, unit(v)) for k, v in catalog if usable(v)]
    out = {}
    for q, v in queries:
        found = []
        if usable(v):
            u = unit(v)
            found = [(float(np.clip(np.float32(u @ w), -1, 1)), -k) for k, w in others if not (exclude_self and k == q)]
        out[q] = (-max(found)[1], round(max(found)[0], 5)) if found else (None, None)
    return out


def run(spark, queries, catalog, **settings):
    got = search.search(frame(spark, queries), frame(spark, catalog), **settings).collect()
    assert len(got) == len(queries)
    return {r["id"]: (r["match_id"], None if r["score"] is None else round(r["score"], 5)) for r in got}, {r["id"]: r["compared"] for r in got}


def clustered(n, d=32, centres=20, spread=0.15, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    return [(k, middle[rng.integers(centres)] + spread * rng.normal(size=d)) for k in range(n)]


@pytest.mark.parametrize("pivots", [1, 7, 60, None])
def test_equals_all_pairs(spark, monkeypatch, pivots):
    monkeypatch.setattr(search, "DIRECT_BYTES", 0)
    rng = np.random.default_rng(1)
    rows = clustered(400, d=8) + [(1000 + k, rng.normal(size=8)) for k in range(100)]
    rows += [(2000 + k, rows[k % 3][1]) for k in range(40)]  # ties
    rows += [(3000, [0] * 8), (3001, [0] * 8), (3002, None), (3003, [float("nan")] * 8), (3004, [None] + [1] * 7), (3005, -np.array(rows[0][1]))]
    queries = rows[::5] + [(9000 + k, rng.normal(size=8)) for k in range(30)] + [(9100, [0] * 8), (9101, None), (9102, [float("inf")] * 8)]
    assert run(spark, queries, rows, pivots=pivots)[0] == plain(queries, rows)
    assert run(spark, rows, rows, pivots=pivots, exclude_self=True, same=True)[0] == plain(rows, rows, True)


def test_blocks_parts_and_copies_change_nothing(spark, monkeypatch):
    rows = clustered(300, d=8, centres=3) + [(500 + k, clustered(1, d=8)[0][1]) for k in range(200)]  # one vector many times
    expected = plain(rows, rows, True)
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 25)
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 8 * 30)
    assert run(spark, rows, rows, pivots=12, exclude_self=True)[0] == expected


def test_few_vectors(spark, monkeypatch):
    for direct in (0, 1 << 20):
        monkeypatch.setattr(search, "DIRECT_BYTES", direct)
        assert run(spark, [(1, [1, 0])], [])[0] == {1: (None, None)}
        assert run(spark, [], [(1, [1, 0])])[0] == {}
        assert run(spark, [(1, [1, 0])], [(1, [1, 0])], exclude_self=True)[0] == {1: (None, None)}
        assert run(spark, [(1, [1, 0]), (2, [-1, 0])], [(5, [0, 3]), (4, [-2, 0])])[0] == {1: (5, 0.0), 2: (4, 1.0)}


def test_most_pairs_are_never_compared(spark):
    rows = clustered(5000, d=48, centres=100, spread=0.1)
    got, compared = run(spark, rows, rows, exclude_self=True, same=True, pivots=200)
    sample = rows[::97]
    expected = plain(sample, rows, True)
    assert {k: got[k] for k, _ in sample} == expected
    assert sum(compared.values()) < 5000 * 5000 / 25
    near = {k: v for k, v in rows}
    queries = [(10_000 + k, near[k] * 1.5) for k in range(0, 5000, 50)]  # copies: the first match ends the search
    _, compared = run(spark, queries, rows, pivots=200)
    assert sum(compared.values()) < len(queries) * 5000 / 25


def test_no_vector_goes_to_every_block(spark, monkeypatch):
    """What is written of the queries for the second visit stays near what their bounds need."""
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 48 * 200)
    rows = clustered(4000, d=48, centres=40, spread=0.05)
    layouts = []
    made = search.Layout

    def kept(*a):
        layouts.append(made(*a))
        return layouts[-1]

    monkeypatch.setattr(search, "Layout", kept)
    written = []
    original = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append((label, out := original(df, label))) or out)
    monkeypatch.setattr(search, "discard", lambda *_: None)
    search.search(frame(spark, rows), frame(spark, rows), pivots=80).count()
    sent = dict(written)["first-matches"].agg(F.sum(F.size("blocks"))).first()[0]
    assert layouts[0].blocks >= 15 and sent < 4000 * layouts[0].blocks / 5


def test_layout():
    rng = np.random.default_rng(2)
    pivots = rng.normal(size=(9, 4))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    counts = np.array([5, 0, 100, 3, 40, 1, 7, 0, 2])
    layout = search.Layout(pivots, counts, np.zeros(9), 20)
    assert sorted(layout.order()) == list(range(9))
    assert layout.parts.tolist() == [1, 1, 5, 1, 2, 1, 1, 1, 1]
    cells, ids = np.repeat(np.arange(9), counts), np.arange(counts.sum())
    block = layout.block_of(cells, ids)
    assert block.max() < layout.blocks and np.bincount(block, minlength=layout.blocks).max() <= 45
    assert all(len({int(b) for b in block[cells == c]}) <= layout.parts[c] for c in range(9))
