"""Exact k-means on integer vectors with a progressive search over Walsh-Hadamard coefficients.

The transform of integers needs additions only and multiplies every squared distance by the dimension, so
all comparisons are exact.  Coefficients are ordered by sequency, coarse to fine.  For every vector the
first block of coefficients gives a lower bound of the distance to each centroid; the centroid with the
least bound is measured in full, and what is strictly worse than it goes.  The rest is refined block by
block, losing more centroids after each, until the survivors have all coefficients.  Of equal distances the
smaller number wins, which elimination of strictly worse centroids never touches.

A round is one pass over the table: tasks assign their rows and send one row of counts and sums a centroid,
so neither a popular centroid nor the size of the table shows in the shuffle.  The centroids themselves,
``k`` rows, are all that the driver holds and hands to the tasks.  The last pass writes ids, numbers and
distances once, since they are read twice.

Defined results: rows whose vector is null, has another dimension, or a component that is null, NaN or
infinite are left out; repeated rows count each by itself; fewer vectors than centroids give as many
centroids as there are vectors; rows without an id are clustered, but start no centroid unless too few others
are there; rows that share an id start in the order of their components; a centroid without vectors stays
where it is; distances (and sums of them) beyond a long are NULL, though compared exactly; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.workspace import materialize

#: Rows that are assigned at once.
STEP = 4096
#: Components below this size over the dimension have transforms whose squared distances fit 64 bits.
SMALL = 1 << 30
#: Sums travel in digits of this many bits, so that partial sums of any size can be added as longs.
DIGIT = 40
LONG = 1 << 63


def hadamard(m: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (dimension a power of two), coefficients by sequency."""
    n = m.shape[1]
    m = m.copy()
    half = 1
    while half < n:
        m = m.reshape(len(m), -1, 2, half)
        m = np.stack([m[:, :, 0] + m[:, :, 1], m[:, :, 0] - m[:, :, 1]], axis=2).reshape(len(m), n)
        half *= 2
    return m[:, sequency(n)]


def sequency(n: int) -> np.ndarray:
    """The natural position of each coefficient, in order of its basis function's sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def steps(n: int) -> list[tuple[int, int]]:
    """Blocks of coefficients, coarse to fine."""
    ends = [e for e in (n // 16, n // 8, n // 4, n // 2, n) if e]
    return list(zip([0, *ends], ends))


def search(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``centres`` (transformed) for each transformed row: its number, and the squared distance in coefficients."""
    (_, first), *finer = steps(x.shape[1])
    gap = x[:, None, :first] - centres[None, :, :first]
    sums = (gap * gap).sum(axis=2)
    likely = sums.argmin(axis=1)
    gap = x - centres[likely]
    most = (gap * gap).sum(axis=1)
    row, number = np.nonzero(sums <= most[:, None])
    sums = sums[row, number]
    for start, end in finer:
        gap = x[row, start:end] - centres[number, start:end]
        sums = sums + (gap * gap).sum(axis=1)
        kept = sums <= most[row]
        row, number, sums = row[kept], number[kept], sums[kept]
    # every row keeps its nearest centroid; its entries stand together, by number
    at = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(sums, at)
    hit = np.flatnonzero(sums == best[row])
    _, where = np.unique(row[hit], return_index=True)
    return number[hit[where]], best


def whole(column: pa.Array, dimension: int, scale: int) -> np.ndarray:
    """floor(scale * component) of each row as integers of any size."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    scaled = np.floor(scale * flat)
    if scaled.size and np.abs(scaled).max() * dimension >= SMALL:
        return np.array([[int(v) for v in r] for r in scaled.tolist()], object)
    return scaled.astype(np.int64)


def assign(m: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance of each row of integers."""
    big = m.dtype == object or max((abs(v) for c in centres for v in c), default=0) * m.shape[1] >= SMALL
    c = hadamard(np.array(centres, object if big else np.int64))
    m = m.astype(object) if big else m
    numbers, distances = [np.zeros(0, np.int64)], [m[:0, 0]]
    for i in range(0, len(m), STEP):
        number, distance = search(hadamard(m[i : i + STEP]), c)
        numbers.append(number)
        distances.append(distance // m.shape[1])
    return np.concatenate(numbers), np.concatenate(distances)


def digits(value: int) -> list[int]:
    """``value`` as digits of ``DIGIT`` bits, the last of which has the sign."""
    out = []
    while not -(1 << DIGIT) < value < 1 << DIGIT:
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def usable(vector: Column, dimension: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(vector) == dimension) & ~F.exists(vector, bad)


def start(rows: DataFrame, k: int, dimension: int, scale: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").toArrow()
    column = first.column(0).combine_chunks()
    return [[int(v) for v in r] for r in whole(column, dimension, scale)] if len(column) else []


def moved(rows: DataFrame, centres: list[list[int]], dimension: int, scale: int) -> list[list[int]]:
    """The centroids after one round: the floored mean of their vectors, or where they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centres), np.int64)
        sums = np.zeros((len(centres), dimension), object)
        for batch in batches:
            m = whole(batch.column("vector"), dimension, scale)
            number, _ = assign(m, centres)
            counts += np.bincount(number, minlength=len(centres))
            for c in np.unique(number):
                sums[c] += m[number == c].sum(axis=0).astype(object)
        out = []
        for c in np.flatnonzero(counts):
            parts = [digits(int(v)) for v in sums[c]]
            for place in range(max(map(len, parts))):
                out.append((int(c), place, int(counts[c]) if place == 0 else 0, [p[place] if place < len(p) else 0 for p in parts]))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("number", "place", "n", "part"), r)) for r in out],
            pa.schema([("number", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("part", pa.list_(pa.int64()))]),
        )

    parts = rows.select("vector").mapInArrow(run, "number int, place int, n long, part array<long>")
    totals = parts.groupBy("number", "place").agg(F.sum("n").alias("n"), *[F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(dimension)])
    counts, sums = [0] * len(centres), [[0] * dimension for _ in centres]
    for r in totals.collect():  # a few rows a centroid
        counts[r["number"]] += r["n"]
        for i in range(dimension):
            sums[r["number"]][i] += r[f"s{i}"] << (DIGIT * r["place"])
    return [[s // n for s in total] if n else old for old, total, n in zip(centres, sums, counts)]


def kmeans(vectors: DataFrame, id: str, vector: str, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every usable row, and the final centroids; ``dimension`` is a power of two."""
    if dimension & (dimension - 1) or dimension < 1:
        raise ValueError(f"dimension {dimension}: want a power of two")
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).filter(usable(F.col("vector"), dimension))
    centres = start(rows, k, dimension, scale, seed)
    for _ in range(rounds if centres else 0):
        centres = moved(rows, centres, dimension, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = assign(whole(batch.column("vector"), dimension, scale), centres)
            if distance.dtype == object:
                distance = [int(d) if d < LONG else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance long"), centres


def cluster_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable row."""
    found, centres = kmeans(vectors, id, vector, **settings)
    found = materialize(found, "clustered")
    exact = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(exact.alias("total")).collect()}  # one row a centroid
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda n: int(n) if n is not None and n < LONG else None
    named = [(c, fits(n), fits(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, n in sums.items()]
    about = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(about), "cluster")  # k rows at most
    return out.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(k: int) -> str:
    """One round in SQL: assign every vector, then move the centroids that have some."""
    return f"""
a{k} AS (
    SELECT vec_id, v, c, d FROM (
        SELECT w.vec_id, w.v, z.c, list_sum(list_transform(list_zip(w.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
               row_number() OVER (PARTITION BY w.r ORDER BY list_sum(list_transform(list_zip(w.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), z.c) AS k
        FROM whole w CROSS JOIN c{k} z
    ) WHERE k = 1
)"""


def _move(k: int) -> str:
    return f"""
m{k} AS (
    SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i)::BIGINT[] AS v
    FROM (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i)
    GROUP BY c
),
c{k + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{k} o LEFT JOIN m{k} m ON o.c = m.c)"""


ORACLE = f"""
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS (
    SELECT k - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS k FROM whole) WHERE k <= 16
),{",".join(_round(k) + "," + _move(k) for k in range(3))},{_round(3)}
SELECT a.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 z ON a.c = z.c
"""
