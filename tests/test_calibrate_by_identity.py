"""Calibration works by identity: vectors are searched and scored once for it, and the results are those of all rows."""

import numpy as np
from pyspark.sql import functions as F

from mergewell.operators import search, validate
from mergewell.operators.embed import NgramEmbedder, embed_distinct
from mergewell.plans import calibrate
from mergewell.schemas import FIELDS, PRODUCT, RAW


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _catalog(spark, rows, vectors):
    return spark.createDataFrame(rows, "id long, identity string"), spark.createDataFrame(vectors, "identity string, vector array<float>")


def _both(spark, rows, vectors):
    catalog, v = _catalog(spark, rows, vectors)
    row = lambda df: sorted(((r["id"], r["match_id"], r["score"]) for r in df.collect()), key=repr)
    return row(search.leave_one_out_named(catalog, v)), row(search.leave_one_out(catalog.join(v, "identity").select("id", "vector")))


def test_nearest_others_by_identity_are_those_by_product(spark):
    rng = np.random.default_rng(5)
    vectors = [(f"n{k}", [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(40)]
    vectors += [("zero", [0.0] * 4), ("twin", vectors[0][1]), ("none", None), ("nan", [float("nan"), 1.0, 1.0, 1.0])]
    names = [name for name, _ in vectors]
    rows = [(int(k), names[int(rng.integers(0, len(names)))]) for k in rng.permutation(150)]
    got, expected = _both(spark, rows, vectors)
    assert got == expected and len(got) == 150


def test_repeated_ids_are_never_their_own_match(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])]
    for rows in ([(1, "a"), (1, "a"), (2, "a"), (3, "b")], [(1, "a"), (1, "b"), (2, "c"), (3, "a")], [(1, "a")], [(1, "a"), (2, "c")]):
        got, expected = _both(spark, rows, vectors)
        assert got == expected


def test_an_identity_is_searched_once(spark, monkeypatch):
    sizes, all_of = [], search.leave_one_out
    monkeypatch.setattr(search, "leave_one_out", lambda catalog: sizes.append(catalog.count()) or all_of(catalog))
    catalog, v = _catalog(spark, [(k, f"n{k % 3}") for k in range(60)], [(f"n{k}", [1.0, float(k)]) for k in range(3)])
    found = {r["id"]: r["match_id"] for r in search.leave_one_out_named(catalog, v).collect()}
    assert sizes == [3] and found == {k: k % 3 if k >= 3 else k + 3 for k in range(60)}


def test_records_are_joined_with_scores_not_with_vectors(spark):
    rows = [(k, f"00000000-0000-0000-0000-{k:012d}", "s", f"thing {k % 4}", "b" if k % 3 else "x", "c") for k in range(40)]
    entries = spark.createDataFrame(rows, "record_index long, " + ", ".join(f"{RAW[f]} string" for f in FIELDS))
    products = spark.createDataFrame([(1, "Thing 0", "b", "c"), (2, "thing 1", None, None), (3, "other", "b", "c"), (4, "other", "b", "c")], PRODUCT)
    positives, negatives = calibrate.measure(validate.records(entries), products, NgramEmbedder(16), True)
    assert "vector" not in _plan(positives)
    got = {r["record_index"]: r for r in positives.collect()}
    assert sorted(got) == [k for k in range(40) if k % 4 < 2]
    e = NgramEmbedder(16)
    unit = lambda t: (lambda x: x / np.linalg.norm(x))(e.embed([f"clustering: {t}"])[0].astype(float))
    for k, r in got.items():
        mine = f"thing {k % 4} | brand: {'b' if k % 3 else 'x'} | category: c"
        other = "Thing 0 | brand: b | category: c" if k % 4 == 0 else "thing 1"
        assert r["product_id"] == k % 4 + 1 and r["description"] == f'#{k} "{mine}" ~ {k % 4 + 1} "{other}"'
        assert abs(r["score"] - unit(mine) @ unit(other)) < 1e-5
    assert {(r["id"], r["match_id"]) for r in negatives.collect()} >= {(3, 4), (4, 3)}


def test_texts_are_embedded_in_many_tasks(spark):
    texts = spark.range(100).select(F.concat(F.lit("text "), "id").alias("text"))
    found = embed_distinct(texts, NgramEmbedder(4))
    assert found.count() == 100 and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_records_that_share_an_index_have_each_others_matches(spark):
    rows = [(k, f"00000000-0000-0000-0000-{k:012d}", "s", n, "b", "c") for k, n in [(0, "thing 0"), (0, "thing 1"), (1, "thing 1")]]
    entries = spark.createDataFrame(rows, "record_index long, " + ", ".join(f"{RAW[f]} string" for f in FIELDS))
    products = spark.createDataFrame([(1, "Thing 0", "b", "c"), (2, "thing 1", None, None)], PRODUCT)
    positives, _ = calibrate.measure(validate.records(entries), products, NgramEmbedder(16), True)
    assert sorted((r["record_index"], r["product_id"]) for r in positives.collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 2)]
