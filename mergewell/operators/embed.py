"""Embedders, batched embedding, and a cache of what was embedded before."""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64
#: Bytes of a refused request's answer that an error quotes.
SNIPPET = 512


class Embedder(Protocol):
    """One vector of ``dimension`` for each text, in order."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class HashEmbedder:
    """Deterministic pseudo-random vectors: equal texts are equal, others unrelated.

    FNV-1a of the text seeds a splitmix64 sequence, whose top 24 bits are spread over [-1, 1).
    """

    dimension: int = 32
    name: str = "hash"

    def embed(self, texts: list[str]) -> np.ndarray:
        seeds = np.array([_fnv1a(t.encode()) for t in texts], np.uint64)[:, None]
        with np.errstate(over="ignore"):
            z = seeds + np.arange(1, self.dimension + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        out = (2 * ((z >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - 1).astype(np.float32)
        out[~out.any(axis=1), 0] = 0.5
        return out


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for byte in data:
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class NgramEmbedder:
    """Counts of hashed character trigrams: close texts get close vectors, without any model."""

    dimension: int = 256
    name: str = "ngram"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for k, text in enumerate(texts):
            codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) >> np.uint64(7)
            out[k] = np.bincount((mixed % np.uint64(self.dimension)).astype(np.int64), minlength=self.dimension)
        return out


@dataclass
class LetterEmbedder:
    """Counts of the letters a-z and of digits, one more for any text: simple enough to state in SQL."""

    dimension: int = 28
    name: str = "letters"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 28), np.float32)
        for k, text in enumerate(texts):
            codes = np.frombuffer(text.lower().encode(), np.uint8)
            out[k, :26] = np.bincount(codes[(codes >= 97) & (codes <= 122)] - 97, minlength=26)
            out[k, 26] = ((codes >= 48) & (codes <= 57)).sum()
            out[k, 27] = 1
        return out


class UpstreamError(OSError, ValueError):
    """The model server can't be reached, or its answer can't be used."""


class StatusError(UpstreamError):
    """The server answered with another status than 200; ``body`` is the start of what it said."""

    def __init__(self, code: int, body: str):
        super().__init__(f"the model server answered {code}: {body}")
        self.code, self.body = code, body


@dataclass
class HttpEmbedder:
    """A model server's ``/api/embed``: ``{model, input}`` in, ``{embeddings}`` out, 64 texts a call.

    A job sends at most ``at_once`` requests at a time (None: one a running task).  A blank text is the
    caller's ``ValueError``; all that the server does wrong is an ``UpstreamError``.
    """

    url: str
    model: str
    dimension: int
    timeout: float = 120.0
    most_bytes: int = 32 << 20
    at_once: int | None = None

    @property
    def name(self) -> str:
        return self.model

    def embed(self, texts: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(texts), BATCH):
            part = texts[i : i + BATCH]
            if any(not t.strip() for t in part):
                raise ValueError("a blank text can't be embedded")
            body = json.dumps({"model": self.model, "input": part}).encode()
            vectors = self._answer(body)
            if len(vectors) != len(part):
                raise UpstreamError(f"{len(vectors)} vectors for {len(part)} texts")
            out += vectors
        try:
            return checked(np.array(out, np.float32).reshape(len(texts), -1), len(texts), self.dimension)
        except (TypeError, ValueError) as e:
            raise UpstreamError(str(e)) from e

    def _answer(self, body: bytes) -> list:
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                status, raw = answer.status, answer.read(self.most_bytes + 1)
        except urllib.error.HTTPError as e:
            status, raw = e.code, e.read(SNIPPET)
        except (OSError, http.client.HTTPException) as e:
            raise UpstreamError(f"asking the model server: {e}") from e
        if status != 200:
            raise StatusError(status, raw[:SNIPPET].decode(errors="replace").strip())
        if len(raw) > self.most_bytes:
            raise UpstreamError(f"the answer exceeds {self.most_bytes} bytes")
        try:
            vectors = json.loads(raw)["embeddings"]
        except (KeyError, TypeError, ValueError) as e:
            raise UpstreamError(f"the answer has no embeddings: {e!r}") from e
        if not isinstance(vectors, list):
            raise UpstreamError("the answer's embeddings are no list")
        return vectors


def checked(vectors: np.ndarray, n: int, dimension: int) -> np.ndarray:
    if vectors.shape != (n, dimension):
        raise ValueError(f"got vectors of shape {vectors.shape} for {n} texts of dimension {dimension}")
    return vectors


def preflight(embedder: Embedder) -> None:
    """Embed one probe on the driver, to fail before the heavy work does."""
    checked(embedder.embed(["probe"]), 1, embedder.dimension)


def embed_texts(texts: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """``texts`` with ``vector``; batches of 64 within each task, in no more tasks than the embedder takes ``at_once``."""
    kept = texts.select(column)
    if at_once := getattr(embedder, "at_once", None):
        kept = kept.repartition(at_once)  # what comes before keeps its own parallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for i in range(0, len(values), BATCH):
                part = values[i : i + BATCH]
                vectors = checked(embedder.embed(part), len(part), embedder.dimension)
                flat = pa.array(vectors.astype(np.float32).ravel())
                offsets = pa.array(np.arange(0, flat.__len__() + 1, embedder.dimension), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.ListArray.from_arrays(offsets, flat)], [column, "vector"]
                )

    return kept.mapInArrow(run, f"{column} string, vector array<float>")


def spread(texts: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    return texts.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def embed_distinct(texts: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> DataFrame:
    """``text, vector`` of every distinct ``text``, from ``cache (model, text_hash, vector)`` where it is there.

    The cache holds what earlier runs embedded; append ``cache_rows`` of the result to it.
    """
    # by its bytes Spark would put all texts into a few tasks, but a text takes far longer to embed than to read
    distinct = spread(texts.select("text").distinct())
    if cache is None:
        return embed_texts(distinct, embedder)
    own = cache.filter(F.col("model") == embedder.name).select("text_hash", "vector")
    hashed = distinct.withColumn("text_hash", F.sha2("text", 256))
    known = hashed.join(own, "text_hash").select("text", "vector")
    new = hashed.join(own, "text_hash", "left_anti").select("text")
    return known.unionByName(embed_texts(new, embedder))


def cache_rows(embedded: DataFrame, embedder: Embedder) -> DataFrame:
    return embedded.select(F.lit(embedder.name).alias("model"), F.sha2("text", 256).alias("text_hash"), "vector")
