"""Exact token counts of whole texts with a two-tier lookup on the map side.

The first tier is a compact table of the token counts of frequent pre-tokens.  It comes from all
texts: every task counts its pre-tokens into a bounded summary and only these summaries are merged,
so no pre-token occurrence is ever shuffled.  The table holds at most ``table_size`` entries, which
bounds what is broadcast.  The second tier is a bounded cache in each Python worker, filled by
encoding the misses of a batch in one call.

Pre-tokens of all scripts feed the first tier, as the tokenizer's file defines them (``pretokens``).  Plain Latin
text is split as a whole; any other chunk between blanks keeps its count in a bounded cache of its own, and only
a chunk that holds a special token's string goes to the library as it is.

Defined results: null and empty text have 0 tokens; repeated rows are counted row by row; pre-tokens
that tie for the last places of the table change speed, not counts; very long texts are split in pieces
of about a million characters; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm.pretokens import PLAIN, SPLIT, Splitter, chunks, frequent, pieces, splitter

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CACHE = 1 << 20
#: Longer chunks are counted without being kept.
CHUNK = 64

_worker: dict = {}


def _state(path: str) -> dict:
    """This worker's splitter and caches."""
    if _worker.get("path") != path:
        own = splitter(path)
        _worker.clear()
        _worker.update(path=path, own=own, cache={}, chunks={})
    return _worker


def _parted(piece: str, own: Splitter) -> tuple[str, list[str]]:
    """The plain part of a piece of text, and the chunks that aren't plain."""
    if own.plain(piece):
        return piece, []
    plain, odd = [], []
    for chunk in chunks(piece):
        (plain if own.plain(chunk) else odd).append(chunk)
    return " ".join(plain), odd


def frequent_lengths(texts: DataFrame, tokenizer_path: str, table_size: int, task_entries: int) -> dict[str, int]:
    """Token counts of the ``table_size`` most frequent pre-tokens found by the tasks' summaries."""
    found = frequent(texts, tokenizer_path, table_size, task_entries)
    own = splitter(tokenizer_path)
    plain = [p for p in found if PLAIN.fullmatch(p)]
    return dict(zip(plain, _lengths(plain, own))) | {p: _length(p, own) for p in found if not PLAIN.fullmatch(p)}


def _length(piece: str, own: Splitter) -> int:
    """Tokens of one pre-token, by the model alone."""
    return len(own.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(own.letters)))


def _lengths(pieces: list[str], own: Splitter) -> list[int]:
    """Tokens of each plain pre-token.  Joined by spaces they are encoded in one call and split apart again."""
    out: list[int] = []
    for i in range(0, len(pieces), 4096):
        part = pieces[i : i + 4096]
        counts = Counter(own.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids)
        if len(counts) != len(part):  # a pre-token that doesn't split alone as it does in its text
            out += [_length(p, own) for p in part]
        else:
            out += [counts[k] for k in range(len(part))]
    return out


def _count(path: str, shared, limit: int):
    def tokens(plain: str, table: dict[str, int], cache: dict[str, int], own: Splitter) -> int:
        found = SPLIT.findall(plain.lower())
        sizes = list(map(table.get, found))
        if None not in sizes:
            return sum(sizes)
        missed = [p for p, n in zip(found, sizes) if n is None]
        new = [p for p in dict.fromkeys(missed) if p not in cache]
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = list(dict.fromkeys(missed))
            cache.update(zip(new, _lengths(new, own)))
        return sum(cache[p] for p in missed) + sum(n for n in sizes if n is not None)

    def odd_tokens(chunk: str, table: dict[str, int], cache: dict[str, int], own: Splitter) -> int:
        words = own.split(chunk)
        if words is None:  # holds a special token's string
            return len(own.tokenizer.encode(chunk, add_special_tokens=False).ids)
        total = 0
        for word in words:
            n = table.get(word)
            if n is None:
                n = cache.get(word)
            if n is None:
                n = _length(word, own)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(word) <= CHUNK:
                    cache[word] = n
            total += n
        return total

    def count(text: str, table: dict[str, int], state: dict) -> int:
        total, own, known = 0, state["own"], state["chunks"]
        for piece in pieces(text):
            plain, odd = _parted(piece, own)
            total += tokens(plain, table, state["cache"], own)
            for chunk in odd:
                n = known.get(chunk)
                if n is None:
                    n = odd_tokens(chunk, table, state["cache"], own)
                    if len(known) >= CACHE:
                        known.clear()
                    if len(chunk) <= CHUNK:
                        known[chunk] = n
                total += n
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, table = _state(path), shared.value
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                counts.append(count(text, table, state))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, table_size: int = 1 << 15, task_entries: int = 1 << 13
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs (doc_id, text)``.

    ``table_size`` bounds the broadcast table, ``task_entries`` the summary a task sends for it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = frequent_lengths(texts.select("text"), tokenizer_path, table_size, task_entries)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return texts.mapInArrow(_count(tokenizer_path, shared, limit), SCHEMA)
