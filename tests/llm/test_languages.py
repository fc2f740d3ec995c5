"""Language identification with more languages than a slice holds."""

import resource
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from mergewell.llm import language_id
from mergewell.llm.textkernel import utf8


def test_every_language_is_learned(spark):
    n = language_id.SLICE + 44
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26] + letters[k * 7 % 26] + letters[k * 11 % 26]
    line = lambda k: f"{word(k)} {word(k)[::-1]} " * (2 if k == n - 1 else 5 + k % 3)
    train = spark.createDataFrame([(f"l{k:03}", line(k)) for k in range(n)], "lang string, text string")
    docs = spark.createDataFrame([(k, True, line(k)) for k in range(n)], "doc_id long, held_out boolean, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, train).collect()}
    assert got == {k: f"l{k:03}" for k in range(n)}


def test_slices_are_the_whole_table(monkeypatch):
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.05, (7, language_id.BUCKETS))
    counts[:, 0] += 1
    lang, bucket = np.nonzero(counts)
    order = rng.permutation(len(lang))
    table = 0.5 + counts
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    for size in (256, 3):
        monkeypatch.setattr(language_id, "SLICE", size)
        model = language_id.Model(list("abcdefg"), *(x[order] for x in (lang, bucket, counts[lang, bucket])))
        assert np.array_equal(np.concatenate([t for _, t in model.slices()]), table)


TEXTS = ["", "a", " . ", "Ein Satz, der noch einer ist.", "x" * 300, "ab " * 200, "Łódź naïve 東京都 " * 20 + "end", ".a.b.c." * 30, "one two\tthree\nfour " * 9 + "der die das " * 9]


def small_model(known=5):
    rng = np.random.default_rng(7)
    counts = rng.poisson(0.4, (known, language_id.BUCKETS))
    lang, bucket = np.nonzero(counts)
    return language_id.Model(list("abcde"[:known]), lang, bucket, counts[lang, bucket])


@pytest.mark.parametrize("size, held", [(1, 99), (2, 0), (7, 300), (64, 0), (64, 1 << 25), (1 << 18, 1 << 25)])
def test_pieces_are_the_whole_text(monkeypatch, size, held):
    """Trigrams and proportions, with words that are longer than a piece."""
    model = small_model()
    monkeypatch.setattr(language_id, "PIECE", size)
    monkeypatch.setattr(language_id, "HELD", held)
    for text in TEXTS:
        data, offsets = utf8(pa.array([text]))
        ids, starts, _ = language_id.trigrams(data, offsets)
        parts = list(language_id.pieces(data))
        assert np.array_equal(np.concatenate([np.zeros(0, int), *[p[0] for p in parts]]), ids)
        assert sum(len(p[1]) - p[3] for p in parts) == len(starts)
        whole = language_id.mixtures(model, data, offsets, 8, 1.0)[0]
        assert np.allclose(language_id.long_mixture(model, data, 8, 1.0), whole, atol=1e-4)


def test_long_texts_take_the_same_results(spark, monkeypatch):
    train = spark.createDataFrame([("en", "the cat and the dog are in the house " * 9), ("de", "der Hund und die Katze sind in dem Haus " * 9)], "lang string, text string")
    long = "the house and the dog " * 260_000  # beyond LONG
    assert len(long) > language_id.LONG
    rows = [(1, False, long), (2, True, long[:2000]), (3, False, "7 " * 3_000_000), (4, False, "der Hund " * 500_000 + "the cat " * 500_000)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), train).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "en" and abs(got[1]["score"] - got[2]["score"]) < 1e-3
    assert (got[3]["lang_pred"], got[3]["score"]) == ("und", 0.0)
    assert set(x.split(":")[0] for x in got[4]["languages"].split(",")) == {"en", "de"} and 0.4 < got[4]["score"] < 0.6
    again = spark.createDataFrame([("en", long)], "lang string, text string")
    counted = language_id.learn(again)
    data, offsets = utf8(pa.array([long]))
    want = np.bincount(language_id.trigrams(data, offsets)[0], minlength=language_id.BUCKETS)
    total = want.sum() + 0.5 * language_id.BUCKETS
    assert np.allclose(next(counted.slices())[1][0], np.log((want + 0.5) / total).astype(np.float32), atol=1e-5)


def test_a_very_long_text_takes_the_memory_of_a_piece():
    model = small_model(3)
    rows = pa.record_batch({"doc_id": pa.array([1]), "held_out": pa.array([False]), "text": pa.array(["words of many kinds, and 1 more. " * (24_000_000 // 33)])})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = list(language_id._predict(SimpleNamespace(value=model), 8, 1.0)(iter([rows])))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert out[0].num_rows == 1 and grown < 150, grown
