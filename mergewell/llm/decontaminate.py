"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size, the number of distinct ``words``-word shingles, in powers of two.  An
item of size n is contained in a text if at least need = ceil(threshold * n) of its shingles occur
there.  Each size partition has a match threshold m of its own, an eighth of its least size: of any
n - need + m of an item's shingles at least m occur in a text that contains it.  So an item's signature
is that many of its smallest shingle hashes (a bottom-k MinHash whose length and threshold follow from
the partition), and a text's signature for a partition is what it has of the hashes up to the largest
one that the partition's signatures hold.  A text with fewer than m hashes in common with an item's
signature can't contain it; candidates are verified by counting all of the item's shingles in the text.

Items shorter than a shingle are partitions of their own: their whole sequence is sought among the
text's sequences of that many words.

Up to ``broadcast_shingles`` index entries are broadcast; a larger benchmark is worked off in slices
of that size, one after the other, each a further pass over the texts, and a slice is freed before the
next is made.

Defined results: an item without words is in no text; an item of fewer words than a shingle is one
shingle, its whole sequence, which every text holds that has these words in a row; null and empty texts
hold nothing; several items with one text are reported each; repeated rows of texts are reported each;
a null ``item_id`` or ``doc_id`` is reported as null; very long texts are searched whole, block by
block; extra columns of either table are ignored; without texts or items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm.textkernel import blocks, distinct, shingle_hashes, word_bounds, word_hashes
from mergewell.workspace import materialize

WORDS = 5
THRESHOLD = 0.75
BROADCAST_SHINGLES = 4_000_000
FOUND = "doc_id long, item_id long, n_shingles int, n_shared int, containment double"


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in blocks(column):
        starts, ends, at = word_bounds(data, offsets)
        yield i, j, word_hashes(data, starts, ends), at


def least_matches(size: int) -> int:
    """How many hashes of an item's signature a text must hold, by the item's size partition."""
    return max(1, (1 << (size.bit_length() - 1)) // 8)


def _sketches(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, hashes, per_row in _word_hashes(batch.column("text")):
                h, at = distinct(*shingle_hashes(hashes, per_row, words))
                for k, n_words in enumerate(np.diff(per_row)):
                    own = h[at[k] : at[k + 1]]
                    need = int(np.ceil(threshold * len(own) - 1e-9))
                    least = min(least_matches(len(own)), need) if len(own) else 0
                    rows.append((min(int(n_words), words), len(own), need, least, len(own) - need + least, own.tobytes()))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["item_id", "words", "size", "needed", "least", "sketch", "shingles"],
            )

    return run


def sketch_items(items: DataFrame, words: int, threshold: float) -> DataFrame:
    """``item_id``, the length of its shingles, its size, what it needs in all and of its signature, the signature's
    length, and its sorted hashes, of which the first are the signature."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    shape = "item_id long, words int, size int, needed int, least int, sketch int, shingles binary"
    return texts.mapInArrow(_sketches(words, threshold), shape).filter("size > 0")


class Partition:
    """The items of one length of shingles and one size partition: an inverted index of their signatures, and of all their hashes."""

    def __init__(self, rows: list):
        self.items = np.array([k for k, _ in rows], np.int64)
        self.words, self.least = rows[0][1]["words"], np.array([r["least"] for _, r in rows], np.int64)
        self.needed = np.array([r["needed"] for _, r in rows], np.int64)
        sets = [np.frombuffer(bytes(r["shingles"]), np.uint64) for _, r in rows]
        self.posted, self.posted_item = self._sorted([own[: r["sketch"]] for own, (_, r) in zip(sets, rows)])
        self.all, self.all_item = self._sorted(sets)
        self.bound = self.posted[-1]

    @staticmethod
    def _sorted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    def _shared(self, values: np.ndarray, owner: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many of the distinct hashes ``own`` each item has among ``values``."""
        low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        n = high - low
        spots = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[spots], minlength=len(self.items))

    def search(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for the rows' shingle hashes; a row's hashes may repeat."""
        inside = np.flatnonzero(h <= self.bound)
        low = h[inside]
        hits = inside[self.posted[np.searchsorted(self.posted, low)] == low]
        for row in np.unique(np.searchsorted(at, hits, "right") - 1):
            own = np.unique(h[at[row] : at[row + 1]])
            signature = own[: np.searchsorted(own, self.bound, "right")]
            candidates = np.flatnonzero(self._shared(self.posted, self.posted_item, signature) >= self.least)
            if not len(candidates):
                continue
            shared = self._shared(self.all, self.all_item, own)
            for k in candidates[shared[candidates] >= self.needed[candidates]]:
                yield int(row), int(self.items[k]), int(shared[k])


class ContainmentIndex:
    """Size partitions of some items."""

    def __init__(self, rows: list):
        self.ids, self.sizes = [r["item_id"] for r in rows], [r["size"] for r in rows]
        parts: dict[tuple[int, int], list] = {}
        for k, r in enumerate(rows):
            parts.setdefault((r["words"], r["size"].bit_length()), []).append((k, r))
        self.partitions = [Partition(own) for _, own in sorted(parts.items())]

    def search(self, hashes: np.ndarray, per_row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for the rows' word hashes."""
        for words in sorted({p.words for p in self.partitions}):
            h, at = shingle_hashes(hashes, per_row, words)
            for p in self.partitions:
                if p.words == words and len(h):
                    yield from p.search(h, at)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            out = []
            for i, _, hashes, per_row in _word_hashes(batch.column("text")):
                for row, item, n in index.search(hashes, per_row):
                    out.append((ids[i + row].as_py(), index.ids[item], index.sizes[item], n, n / index.sizes[item]))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
            )

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, _, hashes, per_row in _word_hashes(batch.column("text")):
                keep[[i + row for row, _, _ in index.search(hashes, per_row)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _indexes(items: DataFrame, words: int, threshold: float, broadcast_shingles: int) -> Iterator[tuple]:
    """A broadcast index for each slice of about ``broadcast_shingles`` hashes, and whether it is the only one."""
    sketched = materialize(sketch_items(items, words, threshold), "benchmark")
    total = sketched.agg(F.sum("size")).first()[0] or 0
    slices = max(1, -(-total // broadcast_shingles))
    for k in range(slices):
        own = sketched if slices == 1 else sketched.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(slices)) == k)
        yield items.sparkSession.sparkContext.broadcast(ContainmentIndex(own.collect())), slices == 1


def contaminations(
    docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every item that a text holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shared, only in _indexes(items, words, threshold, broadcast_shingles):
        part = texts.mapInArrow(_search(shared), FOUND)
        if only:
            return part
        part = materialize(part, "contaminations")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def without_items(
    docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds none of the items."""
    for shared, only in _indexes(items, words, threshold, broadcast_shingles):
        docs = docs.mapInArrow(_clean(shared), docs.schema)
        if not only:
            docs = materialize(docs, "clean")
            shared.destroy()
    return docs


ORACLE = r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
               UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
sets AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM texts),
sizes AS (SELECT id, count(*) AS n FROM sets WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, z.n::INTEGER AS n_shingles, count(*)::INTEGER AS n_shared, count(*)::DOUBLE / z.n::DOUBLE AS containment
FROM sets i JOIN sets d ON d.side = 'd' AND d.s = i.s JOIN sizes z ON z.id = i.id JOIN texts t ON t.side = 'i' AND t.id = i.id
WHERE i.side = 'i' AND len(t.w) >= 5 GROUP BY d.id, i.id, z.n HAVING 4 * count(*) >= 3 * z.n
UNION ALL
SELECT d.id, i.id, 1::INTEGER, 1::INTEGER, 1::DOUBLE FROM texts i JOIN texts d
ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
WHERE i.side = 'i' AND d.side = 'd' AND len(i.w) BETWEEN 1 AND 4
"""
