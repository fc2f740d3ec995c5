"""What the quality classifier is trained on."""

import resource

import numpy as np
import pyarrow as pa
import pytest

from mergewell.llm import quality


def test_every_passage_of_the_chosen_rows_teaches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, y: seen.append(sorted(map(len, bags))))
    docs = spark.createDataFrame([(1, "a" * 512 * 33), (2, "b " * 256 * 100), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    quality.train(docs, labels)
    quality.train(docs, labels, most_bytes=1)
    assert seen[0] == [1, 33, 100] and len(seen[1]) == 1


def test_texts_of_one_labelled_id_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, y: seen.append((len(bags), sorted(set(y)))))
    docs = spark.createDataFrame([(1, f"text {k // 2}") for k in range(100)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, label int")
    for most in (4000, 20):
        quality.train(docs, labels, most_labelled=most)
    assert seen[0] == (51, [0.5, 1.0]) and seen[1][0] == 20


def test_labels_of_other_documents_take_no_place(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, bags, y: seen.append(len(bags)))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    quality.train(docs, labels, most_labelled=50)
    assert seen == [30]


def test_sections_carry_the_attention():
    """All sections of a text give what their passages give together."""
    rng = np.random.default_rng(3)
    model = quality.AttentionModel(quality.WIDTH)
    parts = [rng.normal(size=(n, quality.WIDTH)) for n in (5, 1, 40)]
    together = model.score(np.vstack(parts), np.array([0, 46]))[0]
    assert model.score_sections(iter(parts)) == pytest.approx(together, abs=1e-12)


def test_a_very_long_text_takes_the_memory_of_a_section():
    model = quality.AttentionModel(quality.WIDTH)
    text = "words of many kinds, and 1 more. " * (100_000_000 // 33)
    column = pa.array([text, "short", None])
    del text
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    scores = quality.text_scores(model, column)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert len(scores) == 3 and np.isfinite(scores).all() and grown < 512, grown
