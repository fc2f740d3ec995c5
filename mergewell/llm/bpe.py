"""BPE encoding of whole texts by a lexicon of frequent words, and decoding.

Frequent pre-tokens of all texts (bounded summaries of the tasks, so no occurrence is shuffled) are compiled
with their ids into a minimal acyclic transducer.  Its file lies in the cluster's shared folder; Spark hands a
copy to every executor, whose workers map it into memory and share its pages.  Words that it lacks are merged
one by one by the tokenizer's own model, exactly.  Chunks of text keep their ids in a bounded cache of each worker.

Defined results: null and empty texts have no ids and decode to an empty text; null ids decode to null; ids
that the vocabulary lacks are skipped, as the library does; repeated rows are encoded each; pre-tokens that tie
for the last places of the lexicon change speed, not ids; very long texts are split into pieces of about a
million characters; an empty table gives an empty result; extra columns of the documents are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm.lexicon import Lexicon, compile_lexicon
from mergewell.llm.pretokens import Splitter, chunks, frequent, pieces, splitter
from mergewell.workspace import shared_dir

#: Entries of each half of a worker's caches of chunks and of words, and the longest text that they keep.
CHUNKS, WORDS = 1 << 17, 1 << 18
LONGEST = 64
#: Characters of texts that are encoded together, and ids, or rows' characters, of one batch that goes back to Spark, about.
TOGETHER, BATCH = 1 << 20, 1 << 22


def model(own: Splitter):
    """The merges of a tokenizer whose model and decoder are of the kind that is worked with here."""
    rules = own.rules["model"]
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    if any(rules.get(k, v) != v for k, v in plain.items()) or own.rules.get("decoder"):
        raise ValueError("another kind of model or decoder than this operator's")
    return own.tokenizer.model


def merged(own: Splitter, word: str) -> bytes:
    """The ids of one pre-token by the model's own ranks, nothing around it, as 32-bit integers in a row."""
    ids = [t.id for t in own.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(own.letters))] if word else []
    return np.array(ids, np.int32).tobytes()


def merged_together(own: Splitter, words: list[str]) -> list[bytes]:
    """The same for plain pre-tokens, in one call: between blanks each stays what it is."""
    found = own.tokenizer.encode(" ".join(words), add_special_tokens=False)
    counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
    if len(counts) != len(words):
        return [merged(own, w) for w in words]
    ids, at = np.array(found.ids, np.int32).tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    return [ids[i:j] for i, j in zip(at, at[1:])]


class Cache:
    """A bounded table in two halves: what is met lately, and what goes when that is full, but for what is met again."""

    def __init__(self, most: int):
        self.most, self.late, self.old = most, {}, {}

    def keep(self, values: dict[str, bytes]) -> None:
        if len(self.late) > self.most:
            self.old, self.late = self.late, {}
        long = [k for k in values if len(k) > LONGEST]
        self.late.update({k: v for k, v in values.items() if len(k) <= LONGEST} if long else values)


class Encoder:
    """A worker's way from chunks to ids: caches, lexicon, merges."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.own, self.lexicon = splitter(path), lexicon
        model(self.own)
        self.chunks, self.words = Cache(CHUNKS), Cache(WORDS)

    def _words(self, names: list[str], plain: bool) -> dict[str, bytes]:
        """The ids of pre-tokens: met before, from the lexicon, or merged."""
        late, old = self.words.late, self.words.old
        found = {n: ids for n in names if (ids := late.get(n)) is not None}
        again = {n: ids for n in names if n not in found and (ids := old.get(n)) is not None}
        new = [n for n in names if n not in found and n not in again]
        if new:
            ids = dict(zip(new, self.lexicon.get([n.encode() for n in new])))
            unseen = [n for n, known in ids.items() if known is None]
            if unseen:
                ids.update(zip(unseen, merged_together(self.own, unseen) if plain else [merged(self.own, n) for n in unseen]))
            again |= ids
        self.words.keep(again)
        return found | again

    def _new(self, chunks: list[str], plain: bool) -> dict[str, bytes]:
        """The ids of chunks that are not met lately."""
        old, split = self.chunks.old, {}
        known = {c: ids for c in chunks if (ids := old.get(c)) is not None}
        for chunk in chunks:
            if chunk not in known:
                words = self.own.split(chunk, plain)
                if words is None:  # holds a special token's string
                    known[chunk] = np.array(self.own.tokenizer.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes()
                else:
                    split[chunk] = words
        found = self._words(list(dict.fromkeys(chain.from_iterable(split.values()))), plain)
        known.update((chunk, found[words[0]] if len(words) == 1 else b"".join([found[w] for w in words])) for chunk, words in split.items())
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers in a row; what is new in any of them is looked up at once."""
        parts, missing = [], ({}, {})
        for k, text in enumerate(texts):
            for piece in pieces(text):
                found = chunks(piece)
                ids = list(map(self.chunks.late.get, found))
                parts.append((k, found, ids))
                if None in ids:
                    missing[self.own.plain(piece)].update((c, None) for c, known in zip(found, ids) if known is None)
        new = self._new(list(missing[False]), False) if missing[False] else {}
        if missing[True]:
            new |= self._new([c for c in missing[True] if c not in new], True)
        out = [[] for _ in texts]
        for k, found, ids in parts:
            out[k].append(b"".join([new[c] if known is None else known for c, known in zip(found, ids)] if None in ids else ids))
        self.chunks.keep(new)
        return [b"".join(o) for o in out]


def groups_of(texts: pa.Array) -> Iterator[list[str]]:
    """Texts that are encoded together: about a million characters, or one text."""
    group, size = [], 0
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, file: str) -> Encoder:
    if (path, file) not in _encoders:
        _encoders.clear()
        _encoders[path, file] = Encoder(path, Lexicon.open(SparkFiles.get(file)))
    return _encoders[path, file]


def publish(spark: SparkSession, block: bytes) -> str:
    """Write a compiled lexicon to the shared folder and have Spark hand it to every executor; its file name."""
    name = f"lexicon-{hashlib.sha256(block).hexdigest()}.bin"
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(block))
        out.close()
    context.addFile(fs.makeQualified(path).toString())
    return name


def build_lexicon(texts: DataFrame, path: str, words: int, task_entries: int) -> bytes:
    """The lexicon of at most ``words`` frequent pre-tokens of ``texts (text)``."""
    found = frequent(texts, path, words, task_entries)
    own = splitter(path)
    model(own)
    return compile_lexicon((w.encode(), tuple(np.frombuffer(merged(own, w), np.int32).tolist())) for w in found)


def encode_texts(docs: DataFrame, path: str, words: int = 1 << 16, task_entries: int = 1 << 14) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs (doc_id, text)``, as the tokenizer of the file ``path`` gives them.

    ``words`` bounds the lexicon, ``task_entries`` the summary that a task sends for it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    file = publish(docs.sparkSession, build_lexicon(texts.select("text"), path, words, task_entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, file)
        for batch in batches:
            start, size, found = 0, 0, []
            texts = batch.column("text")
            for group in groups_of(texts):
                found += encoder.encode(group)
                size += sum(map(len, found[-len(group) :])) // 4
                if size > BATCH or start + len(found) == batch.num_rows:
                    at = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])])
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(found)), lists], ["doc_id", "ids"])
                    start, size, found = start + len(found), 0, []

    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, skip_special_tokens: bool = False) -> DataFrame:
    """``encoded (doc_id, ids)`` with the ``text`` that the tokenizer of the file ``path`` decodes ``ids`` to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(path)
        model(own)
        specials = {t["content"] for t in own.rules["added_tokens"] if t["special"]} if skip_special_tokens else set()
        names = {i: t for t, i in own.tokenizer.get_vocab().items() if t not in specials}
        tokens = np.array([names.get(i) for i in range(max(names) + 1)], object)
        for batch in batches:
            ids, start, size, found = batch.column("ids"), 0, 0, []
            for k in range(batch.num_rows):
                row = ids[k].values
                if row is None:
                    found.append(None)
                else:
                    row = row.to_numpy()
                    own_tokens = tokens[row[(row >= 0) & (row < len(tokens))]].tolist()
                    found.append(" ".join(own_tokens if None not in own_tokens else filter(None, own_tokens)))
                    size += len(found[-1])
                if size > BATCH or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(found)) for c in batch.columns), pa.array(found, pa.string())], ["doc_id", "ids", "text"])
                    start, size, found = k + 1, 0, []

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    decoded = decode_ids(encode_texts(docs, path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
