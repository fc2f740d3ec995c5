"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE`` bytes.  Each passage becomes frequencies of
pairs of character classes and measures of word repetition, is encoded by a small layer, and gets a
gated attention weight learned from the document labels alone; the score is read off the weighted
sum of the encodings.  Training uses a bounded sample of labelled documents (``most_labelled``, those
with the smallest hash of their id) on the driver; scoring covers every passage of every text.

Defined results: null and empty text are one passage of zeros and get a score like any other; labels
that are null are ignored and several labels of one document are averaged; with no label at all the
score is 0.5; with labels of one kind it is their mean; repeated rows are scored row by row and teach
once; ids that tie on their hash are taken in their order, texts of one id in that of their hash; texts beyond a
megabyte are read in sections of a megabyte, each with passages of its own, and attention is carried from
section to section, so memory is that of a section and the score that of all; an empty table gives an empty result; extra columns are ignored by
``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm.language_id import held_out
from mergewell.llm.textkernel import BLOCK, blocks, word_bounds, word_hashes
from mergewell.workspace import discard, materialize

PASSAGE = 512
SECTION = BLOCK  # bytes of a text that are in work at once, a multiple of the passage
CLASSES = 16
WIDTH = CLASSES * CLASSES + 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    table = np.full(256, 12, np.int64)
    for k, chars in enumerate((" ", "\t\n\v\f\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
                               ".", ",", "!?", "*", "#", "%&$@~^", "|")):
        table[[ord(c) for c in chars]] = k
    table[[ord(c) for c in "\"'()[]{}<>"]] = 13
    table[0x80:0xC0] = 14
    table[0xC0:] = 15
    return table


CLASS_OF = _classes()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a block (passages x WIDTH), and the offsets of each row's passages."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    at = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    spot = np.arange(len(data)) - offsets[:-1][rows]
    passage = at[:-1][rows] + spot // PASSAGE
    pairs = np.zeros((at[-1], CLASSES * CLASSES), np.float32)
    rest = np.zeros((at[-1], 4), np.float32)
    if len(data):
        kinds = CLASS_OF[data]
        following = np.append(kinds[1:], 1)
        following[offsets[1:][sizes > 0] - 1] = 1
        found = np.bincount((passage * CLASSES + kinds) * CLASSES + following, minlength=pairs.size)
        length = np.maximum(1, np.bincount(passage, minlength=at[-1]))[:, None]
        pairs = np.sqrt(found.reshape(pairs.shape) / length).astype(np.float32)
        rest[:, 0] = length[:, 0] / PASSAGE
        starts, ends, per_row = word_bounds(data, offsets)
        if len(starts):
            words, where = word_hashes(data, starts, ends), passage[starts]
            row = np.repeat(np.arange(len(sizes)), np.diff(per_row))
            n = np.maximum(1, np.bincount(where, minlength=at[-1]))
            rest[:, 1] = np.minimum(np.bincount(where, ends - starts, at[-1]) / n / 16, 8)
            for k in (1, 2):
                same = np.zeros(len(words))
                same[k:] = (words[k:] == words[:-k]) & (row[k:] == row[:-k])
                rest[:, 1 + k] = np.bincount(where, same, at[-1]) / n
    return np.hstack([pairs, rest]), at


def sections(data: np.ndarray) -> Iterator[np.ndarray]:
    """Features of the passages of one text, section by section."""
    for i in range(0, max(1, len(data)), SECTION):
        part = data[i : i + SECTION]
        yield passages(part, np.array([0, len(part)]))[0]


class AttentionModel:
    """Gated attention over encoded passages (Ilse, Tomczak and Welling, 2018), fitted by Adam."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, hidden), "U": draw(hidden, hidden),
                  "w": draw(hidden), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def _forward(self, x: np.ndarray, at: np.ndarray) -> tuple:
        p, rows = self.p, np.repeat(np.arange(len(at) - 1), np.diff(at))
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, at[:-1])[rows])
        weight = e / np.add.reduceat(e, at[:-1])[rows]
        z = np.add.reduceat(h * weight[:, None], at[:-1], axis=0)
        return h, a, g, weight, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"]))), rows

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return self._forward((x - self.mean) / self.scale, at)[5]

    def score_sections(self, parts: Iterator[np.ndarray]) -> float:
        """The score of one text from its sections: sums weighted by attention are carried, scaled to the largest so far."""
        if self.constant is not None:
            return self.constant
        p, top, total, z = self.p, -np.inf, 0.0, 0.0
        for x in parts:
            h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
            most = max(top, e.max())
            weight, old = np.exp(e - most), np.exp(top - most)
            total, z, top = total * old + weight.sum(), z * old + weight @ h, most
        return float(1 / (1 + np.exp(-(z / total @ p["c"] + p["d"][0]))))

    def _gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, a, g, weight, z, score, rows = self._forward(x, at)
        ds = (score - y) / len(y)
        dz = (ds[:, None] * p["c"])[rows]
        da = (dz * h).sum(axis=1)
        de = weight * (da - np.add.reduceat(weight * da, at[:-1])[rows])
        left, right = de[:, None] * p["w"] * g * (1 - a * a), de[:, None] * p["w"] * a * g * (1 - g)
        dh = (weight[:, None] * dz + left @ p["V"].T + right @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ left, "U": h.T @ right, "w": (a * g).T @ de,
                "c": z.T @ ds, "d": np.array([ds.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, size: int = 64, rate: float = 0.01, decay: float = 1e-4) -> None:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        n = sum(map(len, bags))
        self.mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(axis=0) for b in bags) / n) + 1e-2
        rng, step = np.random.default_rng(11), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            pace = rate * (1 - epoch / epochs)
            for i in range(0, len(y), size):
                part = order[i : i + size]
                at = np.concatenate([[0], np.cumsum([len(bags[k]) for k in part])])
                x = (np.vstack([bags[k] for k in part]) - self.mean) / self.scale
                slopes = self._gradient(x, at, y[part])
                step += 1
                for k, slope in slopes.items():
                    slope = slope + decay * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    self.p[k] = self.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for _, _, data, offsets in blocks(batch.column("text")):
            if len(data) > SECTION and len(offsets) == 2:
                bags.append(b"".join(x.astype(np.float32).tobytes() for x in sections(data)))
                continue
            x, at = passages(data, offsets)
            bags += [x[i:j].astype(np.float32).tobytes() for i, j in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"]
        )


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, most_bytes: int = 128 << 20) -> AttentionModel:
    """Fit on every passage of at most ``most_labelled`` documents with a row in ``labels (doc_id, label)``.

    Labels of documents that aren't in ``docs`` are left aside before they are counted.

    The documents end, in the order of the hashes of their id and text, before their passages (1,040 bytes
    each) take more than ``most_bytes``; the first is always taken.  Rows that repeat id and text count
    once, and different texts of one id count each, so no id brings more than that to the driver.
    """
    chosen = (
        labels.filter("doc_id is not null and label is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col("label").cast("double")).alias("label"))
        .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
        .collect()
    )
    model = AttentionModel(WIDTH)
    if not chosen:
        model.fit([], np.zeros(0))
        return model
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, label double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # repeats of a row are combined before anything is brought together
    taught = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("text_hash", F.xxhash64("text"))
    taught = materialize(taught, "taught")
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)).alias("n")
    listed = taught.select("doc_id", "text_hash", n).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(most_labelled).collect()
    taken, room = [], most_bytes // (4 * WIDTH)
    for r in listed:
        room -= r["n"]
        if room < 0 and taken:
            break
        taken.append((r["doc_id"], r["text_hash"]))
    sample = docs.sparkSession.createDataFrame(taken, "doc_id long, text_hash long")
    found = taught.join(F.broadcast(sample), ["doc_id", "text_hash"]).select("doc_id", "label", "text").mapInArrow(_bags, "doc_id long, label double, bag binary").collect()
    discard(taught)
    found = sorted(((r["doc_id"], bytes(r["bag"]), r["label"]) for r in found))
    bags = [np.frombuffer(bag, np.float32).reshape(-1, WIDTH) for _, bag, _ in found]
    model.fit(bags, np.array([y for *_, y in found]))
    return model


def text_scores(model: AttentionModel, column: pa.Array) -> np.ndarray:
    """The score of each text of a column."""
    scores = [np.zeros(0)]
    for _, _, data, offsets in blocks(column):
        long = len(data) > SECTION and len(offsets) == 2
        scores.append(np.array([model.score_sections(sections(data))]) if long else model.score(*passages(data, offsets)))
    return np.concatenate(scores)


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = text_scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, remainder: int = 0, most_labelled: int = 4000
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; held-out rows teach nothing."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out(modulus, remainder))
    shared = docs.sparkSession.sparkContext.broadcast(train(texts, fold, most_labelled))
    return texts.withColumn("held_out", held_out(modulus, remainder)).mapInArrow(_score(shared, threshold), SCHEMA)


def _passing(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array(text_scores(model, batch.column("text")) >= threshold))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labelled: int = 4000) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``."""
    fold = labels.select("doc_id", F.col("quality").alias("label"))
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, fold, most_labelled))
    return docs.mapInArrow(_passing(shared, threshold), docs.schema)
