"""BPE by a compiled lexicon, against the tokenizer library and exact round trips."""

import hashlib
import os
import random

import numpy as np
import pytest

from mergewell.llm import bpe, lexicon, pretokens

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    return path, pytest.importorskip("tokenizers").Tokenizer.from_file(path)


def odd_texts():
    texts = [
        None, "", " ", "\x0b", "It's a test, isn't it?", "<|endoftext|> in a text <|startoftext|>", "a<|endoftext|>b<|endoftext|>", "ΑΣ Σ ς İstanbul ﬁ Å",
        "x" * 50_000, "!!'s ''s a''t 12 345", "a b\x1cc\x85d\xa0e é É", "日本語 テキスト 😀", "“curly” – dash", "一二三。四五，六" * 500 + "。a" * 2000 + "،" * 1000,
        "ǅ ŉ ß ẞ J̌ ẖ", "á́̂ é", " ̈x", "tab\tand\nline " * 300, "''", "' s", "Ünï̈", "12345678901234567890", "a\x00b",
    ]
    rng = random.Random(3)
    letters = "abcéß '.,!-12\n\tXYΣ́語。<|>endoftxstar ‍"
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(300)]


def digest(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def key(row):
    return repr(row[0]), row


def test_against_the_library(spark, tokenizer):
    path, library = tokenizer
    rows = [(k, t, "x", 1) for k, t in enumerate(odd_texts())] + [(0, "again", "x", 1), (None, "no id", "x", 1), (4, odd_texts()[4], "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, bpe.digest(df, path).collect()), key=repr)
    assert got == sorted((digest(library, i, t) for i, t, *_ in rows), key=repr)
    few = bpe.encode_texts(df, path, words=30, task_entries=40).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in few) == sorted((repr(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows)
    assert bpe.digest(df.limit(0), path).count() == 0


def test_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "TOGETHER", 10)
    texts = ["abc", None, "x" * 30, "", "abcdefgh", "abc", "abcdefg"]
    assert list(bpe.groups_of(pa.array(texts))) == [["abc", ""], ["x" * 30], ["", "abcdefgh"], ["abc", "abcdefg"]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_whole_table(spark, tokenizer):
    path, library = tokenizer
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(map(tuple, bpe.digest(docs, path).collect()))
    assert got == sorted(digest(library, r["doc_id"], r["text"]) for r in docs.collect())


def test_decoding(spark, tokenizer):
    path, library = tokenizer
    rows = [(1, [320, 49407, 2368]), (2, []), (3, None), (4, [320, 60000, 320])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    for skip in (False, True):
        got = {r["doc_id"]: r["text"] for r in bpe.decode_ids(df, path, skip).collect()}
        assert got == {i: None if ids is None else library.decode(ids, skip_special_tokens=skip) for i, ids in rows}


def encoded(encoder, texts):
    return [np.frombuffer(ids, np.int32).tolist() for ids in encoder.encode(texts)]


def test_batches_are_split_by_size(tokenizer, monkeypatch):
    path, library = tokenizer
    block = lexicon.compile_lexicon([])
    encoder = bpe.Encoder(path, lexicon.Lexicon(block))
    monkeypatch.setattr(pretokens, "PIECE", 40)
    encoder.chunks.most = encoder.words.most = 5
    texts = [text or "" for text in odd_texts()]
    for group in (texts[:5], texts[5:30], texts[30:31], texts[31:], texts):
        assert encoded(encoder, group) == [library.encode(text, add_special_tokens=False).ids for text in group]
    for k in range(9):  # full halves go one after the other
        encoder.encode([f"word{'abcdefghi'[k]} other{'abcdefghi'[k]}"])
    assert all(len(half) < 20 for cache in (encoder.chunks, encoder.words) for half in (cache.late, cache.old))


def test_long_chunks_are_cut_where_nothing_changes(tokenizer, monkeypatch):
    path, library = tokenizer
    monkeypatch.setattr(pretokens, "LONG", 3)
    encoder = bpe.Encoder(path, lexicon.Lexicon(lexicon.compile_lexicon([])))
    for text in [*odd_texts(), "a.b,c!d", "no,'s.Öl.ö;é:A", "一、二。三<|endoftext|>。a"]:
        assert encoded(encoder, [text or ""]) == [library.encode(text or "", add_special_tokens=False).ids]


def test_another_tokenizer_is_refused(tokenizer):
    with pytest.raises(ValueError, match="another"):
        pretokens.check(os.path.join(os.path.dirname(tokenizer[0]), "byte_bpe_50k.json"))


def words_of(seed, n):
    rng = random.Random(seed)
    return {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))).encode(): tuple(rng.randint(0, 6) for _ in range(rng.randint(1, 4))) for _ in range(n)}


def ids(found, words):
    got = found.get(list(words))
    return {w: None if g is None else tuple(np.frombuffer(g, np.int32).tolist()) for w, g in zip(words, got)}


def test_transducer_gives_what_was_put_in():
    for seed, n in ((1, 0), (2, 1), (3, 50), (4, 3000)):
        words = words_of(seed, n)
        found = lexicon.Lexicon(lexicon.compile_lexicon(words.items()))
        assert ids(found, words) == words
        others = words_of(seed + 100, 500)
        assert all(i is None for i in ids(found, [w for w in others if w not in words]).values())
    empty = lexicon.Lexicon(lexicon.compile_lexicon([(b"", (7,)), (b"a", ())]))
    assert ids(empty, [b"", b"a", b"b", b"ab"]) == {b"": (7,), b"a": (), b"b": None, b"ab": None}


def test_transducer_is_minimal():
    """No two states accept the same rest with the same ids."""
    words = {w: (1,) for w in words_of(9, 400)}
    found = lexicon.Lexicon(lexicon.compile_lexicon(words.items()))

    def rests(prefix):
        return frozenset(w[len(prefix) :] for w in words if w.startswith(prefix))

    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    # the one id stands on the first arc, so a state after the root is told by its rests alone
    assert found.states == len({rests(p) for p in prefixes if p}) + 1


def test_block_is_mapped_from_a_file(folder):
    words = words_of(5, 100)
    with open(f"{folder}/lexicon", "wb") as file:
        file.write(lexicon.compile_lexicon(words.items()))
    found = lexicon.Lexicon.open(f"{folder}/lexicon")
    assert ids(found, words) == words
    with pytest.raises(ValueError, match="lexicon"):
        lexicon.Lexicon(b"x" * 100)
