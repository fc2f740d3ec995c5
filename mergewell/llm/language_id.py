"""Language identification as inference of a mixture.

A language's model is its distribution of hashed byte trigrams, counted over all training texts.  A
text is a bag of words, each written in one language; expectation-maximisation estimates the
proportions of the languages from the words' trigram likelihoods.  The set of a text's languages starts
with the one that has the largest proportion among all, and grows by the next as long as the penalised
likelihood of the fit within the set does; no number of languages is fixed.  The prediction is the
language with the largest proportion in the set.

Defined results: null text and text without a letter get ``und`` and score 0, as does everything if
there is nothing to learn from; ties go to the language that sorts first; a null ``doc_id`` is never
learned from and not held out; repeated rows are scored row by row; texts beyond ``LONG`` bytes are gone through
piece by piece; words of equal likelihoods are one row with a count, and what doesn't fit in ``HELD`` bytes is gone
through again in each round of the expectation-maximisation (all words count all the same); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm.textkernel import LOWER, blocks, mix, reduce_rows
from mergewell.workspace import materialize

BUCKETS = 1 << 15
#: Texts of more bytes are worked on in pieces of ``PIECE`` bytes.
LONG = 4 << 20
PIECE = 1 << 18
#: Bytes of their words' log likelihoods that are held.
HELD = 32 << 20
#: So many of them are turned into likelihoods at a time.
ROWS = 1 << 15
#: So many languages' log probabilities are held spread out (128 KB each).
SLICE = 256
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages string"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte, word starts among them, words per row."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + n + 2, 0x20, np.uint8)
    spots = np.arange(len(data)) + rows + 1
    padded[spots] = LOWER[data]
    letter = LETTER[padded]
    padded[~letter] = 0x20
    at = np.flatnonzero(letter)
    wide = padded.astype(np.uint64)
    ids = mix((wide[at - 1] << np.uint64(16)) | (wide[at] << np.uint64(8)) | wide[at + 1])
    ids = (ids >> np.uint64(49)).astype(np.int64)  # 15 bits
    starts = np.flatnonzero(~letter[at - 1])
    bounds = offsets + np.arange(n + 1) + 1
    return ids, starts, np.searchsorted(at[starts], bounds)


def pieces(data: np.ndarray, begin: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, bool, bool, int]]:
    """The trigrams of one text from ``begin`` by pieces: buckets, where words start, whether the first goes on
    from the piece before and the last into the next, and the piece's end."""
    for first in range(begin, len(data), PIECE):
        end = min(first + PIECE, len(data))
        part = np.full(end - first + 2, 0x20, np.uint8)
        low, high = max(first - 1, 0), min(end + 1, len(data))
        part[low - first + 1 : high - first + 1] = LOWER[data[low:high]]
        letter = LETTER[part]
        part[~letter] = 0x20
        at = np.flatnonzero(letter[1:-1]) + 1
        if not len(at):
            continue
        wide = part.astype(np.uint64)
        ids = (mix((wide[at - 1] << np.uint64(16)) | (wide[at] << np.uint64(8)) | wide[at + 1]) >> np.uint64(49)).astype(np.int64)
        starts = np.flatnonzero(~letter[at - 1])
        goes_on = bool(letter[0] and letter[1])
        yield ids, np.concatenate([[0], starts]) if goes_on else starts, goes_on, bool(letter[-1] and letter[-2]), end


def _count(most_held: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                full = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full])],
                    ["lang", "bucket", "n"],
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column("text").filter(pa.array(langs == lang))
                counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, _, data, offsets in blocks(texts):
                    long = len(data) > LONG  # one text: a block has a megabyte otherwise
                    for ids in (p[0] for p in pieces(data)) if long else [trigrams(data, offsets)[0]]:
                        counts += np.bincount(ids, minlength=BUCKETS)
            if len(held) > most_held:
                yield from out()
        yield from out()

    return run


class Model:
    """Log probabilities (languages x buckets) of all languages, of which only counted buckets are stored.

    They are spread out in slices of at most ``SLICE`` languages, so that a worker holds one slice at
    a time, whatever the number of languages; a single slice is spread out once.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs = langs
        order = np.argsort(lang, kind="stable")
        lang, self.buckets, n = lang[order], bucket[order].astype(np.uint16), n[order]
        self.at = np.searchsorted(lang, np.arange(len(langs) + 1))
        total = np.bincount(lang, n, len(langs)) + 0.5 * BUCKETS
        self.unseen = np.log(0.5 / total).astype(np.float32)
        self.seen = np.log((n + 0.5) / total[lang]).astype(np.float32)
        self.only = None

    def __len__(self) -> int:
        return len(self.langs)

    def _spread(self, first: int, end: int) -> np.ndarray:
        table = np.repeat(self.unseen[first:end, None], BUCKETS, axis=1)
        for k in range(first, end):
            table[k - first, self.buckets[self.at[k] : self.at[k + 1]]] = self.seen[self.at[k] : self.at[k + 1]]
        return table

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first language, log probabilities) of each slice."""
        if len(self) <= SLICE:
            if self.only is None:
                self.only = self._spread(0, len(self))
            yield 0, self.only
            return
        for first in range(0, len(self), SLICE):
            yield first, self._spread(first, min(len(self), first + SLICE))


def learn(texts: DataFrame) -> Model:
    """The model of every language of ``texts (lang, text)``.

    Counts cover every row; what comes to the driver is 14 bytes a language and bucket that occurs in it.
    """
    counts = materialize(
        texts.mapInArrow(_count(), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")),
        "trigrams",
    )
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    numbers = texts.sparkSession.createDataFrame(list(enumerate(langs)), "k int, lang string")
    found = counts.join(F.broadcast(numbers), "lang").select("k", "bucket", "n").toArrow()
    return Model(langs, *[found.column(c).to_numpy() for c in ("k", "bucket", "n")])


def _sums(model: Model, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language."""
    words = np.empty((len(starts), len(model)), np.float32)
    for first, table in model.slices():
        for k, row in enumerate(table):
            words[:, first + k] = np.add.reduceat(row[ids], starts)
    return words


def _likely(words: np.ndarray) -> np.ndarray:
    return np.exp((words - words.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-12


def _long_words(model: Model, data: np.ndarray, begin: int = 0, carried: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int, np.ndarray | None]]:
    """Log likelihoods of the words that end in each piece of one long text, the piece's end, and what the next one carries on."""
    for ids, starts, goes_on, unfinished, end in pieces(data, begin):
        words = _sums(model, ids, starts)
        if goes_on:
            words[0] += carried
        carried = words[-1].copy() if unfinished else None
        ended = words[: len(words) - unfinished]
        yield ended - ended.max(axis=1, keepdims=True), end, carried


def _merged(rows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Equal rows as one, with the sum of their counts."""
    every, n = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(counts)
    _, at, place = np.unique(every.view(np.dtype((np.void, every.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    return [every[at]], [np.bincount(place, n, len(at))]


def long_mixture(model: Model, data: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Proportions of the kept languages of one text, as ``mixtures`` has them."""
    known = len(model)
    rows, counts = [np.empty((0, known), np.float32)], [np.empty(0)]
    begin, carried = len(data), None
    for words, end, goes_on in _long_words(model, data):
        if len(words):
            (own,), (times,) = _merged([words], [np.ones(len(words))])
            rows.append(own), counts.append(times)
        if sum(map(len, rows[1:])) > len(rows[0]):  # merging all when it may halve them keeps it linear
            rows, counts = _merged(rows, counts)
        if sum(r.nbytes for r in rows) > HELD:
            rows, counts = _merged(rows, counts)
            if rows[0].nbytes > HELD // 2:
                begin, carried = end, goes_on
                break
    rows, counts = _merged(rows, counts)
    n = counts[0].sum() + sum(len(words) for words, _, _ in _long_words(model, data, begin, carried))
    if not n:
        return np.zeros(known)

    def weighted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(rows[0]), ROWS):
            yield _likely(rows[0][k : k + ROWS]), counts[0][k : k + ROWS]
        for words, _, _ in _long_words(model, data, begin, carried):
            if len(words):
                yield _likely(words), np.ones(len(words))

    def fit(share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            total = np.zeros(known)
            for likely, times in weighted():
                part = likely * share
                total += times @ (part / part.sum(axis=1, keepdims=True))
            share = total / n
        return share

    order = np.argsort(-fit(np.full(known, 1 / known), rounds), kind="stable")
    best, kept = -np.inf, np.zeros(known)
    for size in range(1, known + 1):
        inside = np.zeros(known)
        inside[order[:size]] = 1 / size
        fitted = fit(inside, rounds if size > 1 else 0)
        reached = sum(times @ np.log((likely * fitted).sum(axis=1)) for likely, times in weighted())
        reached -= penalty * size * np.log(max(n, 2))
        if reached <= best:
            break
        best, kept = reached, fitted
    return kept


def _fit(likely: np.ndarray, at: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the rows' proportions, and the log likelihood that they reach (without the words' scale)."""
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    share = start
    for _ in range(rounds):
        weighted = likely * share[rows]
        weighted /= weighted.sum(axis=1, keepdims=True)
        share = reduce_rows(np.add, weighted, at, 0) / np.maximum(n, 1)[:, None]
    return share, reduce_rows(np.add, np.log((likely * share[rows]).sum(axis=1)), at, 0)


def mixtures(model: Model, data: np.ndarray, offsets: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Proportions of the kept languages (rows x languages)."""
    ids, starts, at = trigrams(data, offsets)
    known = len(model)
    best_share = np.zeros((len(offsets) - 1, known))
    if not len(starts):
        return best_share
    likely = _likely(_sums(model, ids, starts))
    left, n = np.flatnonzero(np.diff(at)), np.diff(at)[np.diff(at) > 0]
    at = np.concatenate([[0], np.cumsum(n)])
    share, _ = _fit(likely, at, np.full((len(n), known), 1 / known), rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.full(len(n), -np.inf)
    for size in range(1, known + 1):  # the rows that are left have sets that still grow
        inside = np.zeros((len(n), known))
        np.put_along_axis(inside, order[:, :size], 1 / size, axis=1)
        fitted, reached = _fit(likely, at, inside, rounds if size > 1 else 0)
        reached = reached - penalty * size * np.log(np.maximum(n, 2))
        better = reached > best
        best_share[left[better]] = fitted[better]
        if not better.any():
            break
        likely = likely[np.repeat(better, n)]
        left, n, order, best = left[better], n[better], order[better], reached[better]
        at = np.concatenate([[0], np.cumsum(n)])
    return best_share


def _predict(shared, rounds: int, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model.langs
        least = 1 << 16 if len(langs) <= SLICE else 1 << 13
        for batch in batches:
            texts = batch.column("text")
            predicted, scores, sets = [], [], []
            for i, j, data, offsets in blocks(texts, max(least, (1 << 22) // max(1, len(langs)))):
                if not langs:
                    share = np.zeros((j - i, 1))
                elif len(data) > LONG:  # one text, as above
                    share = long_mixture(model, data, rounds, penalty)[None]
                else:
                    share = mixtures(model, data, offsets, rounds, penalty)
                top = share.argmax(axis=1)
                for k in range(j - i):
                    p = share[k, top[k]]
                    if not p or not any(map(str.isalpha, texts[i + k].as_py())):
                        predicted.append(UNKNOWN), scores.append(0.0), sets.append("")
                        continue
                    kept = sorted((q for q in np.flatnonzero(share[k] > 1e-6)), key=lambda q: -share[k, q])
                    predicted.append(langs[top[k]])
                    scores.append(float(min(p, 1.0)))
                    sets.append(",".join(f"{langs[q]}:{share[k, q]:.3f}" for q in kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    pa.array(predicted, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(sets, pa.string()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return run


def identify(
    docs: DataFrame,
    train: DataFrame,
    rounds: int = 8,
    penalty: float = 1.0,
) -> DataFrame:
    """Predict every row of ``docs (doc_id, held_out, text)`` from models of ``train (lang, text)``."""
    model = learn(train.select(F.col("lang").cast("string").alias("lang"), "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _predict(shared, rounds, penalty), SCHEMA
    )


def held_out(modulus: int, remainder: int) -> F.Column:
    """Whether crc32 of the decimal ``doc_id`` leaves ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_documents(docs: DataFrame, modulus: int = 3, remainder: int = 1, **options) -> DataFrame:
    """``identify`` with the documents outside the held-out fold as training texts."""
    kept = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"
    ).withColumn("held_out", held_out(modulus, remainder))
    train = kept.filter(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    return identify(kept, train.filter(F.col("text").isNotNull()), **options)
