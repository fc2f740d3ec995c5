"""Exact cosine comparison of blocks of vectors: threshold joins, edges within a batch.

Both sides are dealt into blocks of at most about ``BLOCK_BYTES``, and a shuffle brings each pair of
blocks together in one task, which multiplies them: nothing is broadcast or passes through the driver,
whatever the sizes, and only one best match per vector and block is shuffled on.  Scores are accumulated
in double precision, cast to float32 and clamped; ties go to the smallest order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from mergewell.functions import vectors
from mergewell.workspace import materialize

BLOCK_BYTES = 32 << 20
#: Rows of a product that are scored at once.
STEP = 256
#: Most tasks that pairs of blocks are dealt to.
MOST_TASKS = 1 << 14


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix of unit rows, rounded as stored vectors are."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0).astype(np.float32).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip((a @ b.T).astype(np.float32), -1, 1)


def extent(side: DataFrame, vector: str = "vector") -> tuple[int, int]:
    """How many rows a side has, and their dimension."""
    n, d = side.agg(F.count("*"), F.max(F.size(vector))).first()
    return n, d or 1


def block_counts(left: tuple[int, int], right: tuple[int, int], cores: int) -> tuple[int, int]:
    """Into how many blocks sides of these extents are dealt: as few as memory allows, and enough pairs for all cores."""
    rows, columns = (max(1, -(-n * 8 * d // BLOCK_BYTES)) for n, d in (left, right))
    return max(rows, min(-(-cores // columns), -(-left[0] // STEP))), columns


def paired(
    left: DataFrame, right: DataFrame, by: tuple[str, str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    extents: tuple[tuple[int, int], tuple[int, int]] | None = None,
) -> DataFrame:
    """``run`` on every pair of a block of ``left (vector, ...)`` and one of ``right (other, ...)``; rows are dealt by the columns ``by``.

    ``extents`` of both sides are counted where they aren't given; upper bounds do.
    """
    extents = extents or (extent(left), extent(right, "other"))
    rows, columns = block_counts(*extents, left.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda side, column, n: side.withColumn("_own", F.pmod(F.xxhash64(column), F.lit(n)).cast("int"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = dealt(left, by[0], rows).withColumnRenamed("_own", "_row").withColumn("_column", all_of(columns))
    b = dealt(right, by[1], columns).withColumnRenamed("_own", "_column").withColumn("_row", all_of(rows))
    return met(a, b, ("_row", "_column"), rows * columns).applyInArrow(run, schema)


def met(a: DataFrame, b: DataFrame, key: tuple[str, ...], groups: int) -> PandasCogroupedOps:
    """The groups of both sides by ``key``, of which there are ``groups``, each in a task of its own but for chance.

    Their work is far more than their bytes, by which Spark would put many groups into a task.
    """
    n = min(2 * groups, MOST_TASKS)
    a, b = (side.repartition(n, *key) for side in (a, b))
    return a.groupBy(*key).cogroup(b.groupBy(*key))


def matrix(table: pa.Table, column: str = "vector") -> np.ndarray:
    v = table.column(column).combine_chunks()
    return unit_rows(v if isinstance(v, pa.Array) else v.chunk(0) if v.num_chunks else pa.array([], v.type))


def _table(parts: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.Table:
    columns = zip(*parts) if parts else [[] for _ in names]
    return pa.table({n: np.concatenate([np.zeros(0, k), *c]) for n, k, c in zip(names, kinds, columns)})


def in_batch_edges(batch: DataFrame, threshold: float) -> DataFrame:
    """``i, j, score`` with ``j`` before ``i`` and a score of at least ``threshold``, for ``batch (id, vector)``.

    Each unordered pair of blocks meets once.
    """
    rows = batch.select(F.col("id").cast("long").alias("id"), "vector")
    size = extent(rows)
    n = max(block_counts(size, size, rows.sparkSession.sparkContext.defaultParallelism))
    own = rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    a = own.withColumnRenamed("_own", "_row").withColumn("_column", F.explode(F.sequence(F.lit(0), "_row")))
    b = own.select(F.col("id").alias("other_id"), F.col("vector").alias("other"), F.col("_own").alias("_column"))
    b = b.withColumn("_row", F.explode(F.sequence(F.col("_column"), F.lit(n - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, y, v, other = left.column("id").to_numpy(), right.column("other_id").to_numpy(), matrix(left), matrix(right, "other")
            same = left.column("_row")[0].as_py() == left.column("_column")[0].as_py()
            for i in range(0, len(x), STEP):
                s = scores(v[i : i + STEP], other)
                good = s >= np.float32(threshold)
                at, to = np.nonzero(good & (y[None, :] < x[i : i + STEP, None]) if same else good)
                p, q = x[i : i + STEP][at], y[to]
                out.append((np.maximum(p, q), np.minimum(p, q), s[at, to]))
        return _table(out, ("i", "j", "score"), (np.int64, np.int64, np.float32))

    return a.groupBy("_row", "_column").cogroup(b.groupBy("_row", "_column")).applyInArrow(run, "i long, j long, score float")


def cells(left: DataFrame, right: DataFrame, threshold: float, pivots: int = 64) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides, dealt to the cells ``_cell, _row, _column`` in which pairs can reach the threshold.

    Every right vector belongs to the nearest of at most ``pivots`` pivots, right vectors themselves (a
    bounded sample, those with the smallest hash).  By the triangle inequality of angles, a left vector
    can only reach a pivot's vectors if it is no further from the pivot than their largest angle plus that
    of the threshold.  No pair over the threshold is lost, whatever the pivots.
    """
    usable = lambda side, name: side.filter(vectors.problem(F.col("vector")).isNull()).select(F.col("id").cast("long").alias(name), F.col("vector").alias("vector"))
    a, b = usable(left, "id"), usable(right, "match_id")
    sample = b.orderBy(F.xxhash64("match_id"), "match_id").limit(pivots).select("vector").toArrow()
    centres = matrix(sample) if sample.num_rows else np.zeros((0, 0))
    limit = float(np.arccos(np.clip(threshold - 1e-6, -1, 1))) + 1e-3

    def angles(batch: pa.RecordBatch) -> np.ndarray:
        return np.arccos(np.clip(unit_rows(batch.column("vector")) @ centres.T, -1, 1))

    def assigned(batches):
        for batch in batches:
            found = angles(batch)
            cell = found.argmin(axis=1) if len(centres) else np.zeros(0, np.int64)
            far = found[np.arange(len(cell)), cell] if len(centres) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["match_id", "vector", "_cell", "_angle"])

    b = materialize(b.mapInArrow(assigned, "match_id long, vector array<float>, _cell int, _angle double"), "cells")
    known = {r["_cell"]: r for r in b.groupBy("_cell").agg(F.max("_angle").alias("far"), F.count("*").alias("n")).collect()}  # one row a pivot
    far = np.array([known[k]["far"] if k in known else -10.0 for k in range(len(centres))])

    def reached(batches):
        for batch in batches:
            near = angles(batch) <= far + limit if len(centres) else np.zeros((batch.num_rows, 0), bool)
            at = np.concatenate([[0], np.cumsum(near.sum(axis=1))])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.nonzero(near)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "vector", "_cells"])

    a = a.mapInArrow(reached, "id long, vector array<float>, _cells array<int>")
    rows, _ = block_counts(extent(left), (1, 1), left.sparkSession.sparkContext.defaultParallelism)
    most = max(1, BLOCK_BYTES // (8 * max(1, centres.shape[1])))
    parts = F.create_map(*[F.lit(x) for k, r in known.items() for x in (k, -(-r["n"] // most))]) if known else F.create_map()
    part = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    a = a.select("id", "vector", part("id", F.lit(rows)).alias("_row"), F.explode("_cells").alias("_cell"))
    if not known:
        return a.withColumn("_column", F.lit(0)), b.withColumn("_column", F.lit(0)).withColumn("_row", F.lit(0))
    a = a.withColumn("_column", all_of(F.element_at(parts, F.col("_cell"))))
    b = b.withColumn("_column", part("match_id", F.element_at(parts, F.col("_cell")))).withColumn("_row", all_of(F.lit(rows)))
    return a, b


def threshold_join(left: DataFrame, right: DataFrame, threshold: float, pivots: int = 64) -> DataFrame:
    """All pairs ``id, match_id, score`` with a score of at least ``threshold``; only pairs of one of the ``cells`` are compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, y, v, other = left.column("id").to_numpy(), right.column("match_id").to_numpy(), matrix(left), matrix(right)
            for i in range(0, len(x), STEP):
                s = scores(v[i : i + STEP], other)
                at, to = np.nonzero(s >= np.float32(threshold))
                out.append((x[i : i + STEP][at], y[to], s[at, to]))
        return _table(out, ("id", "match_id", "score"), (np.int64, np.int64, np.float32))

    a, b = cells(left, right, threshold, pivots)
    key = ("_cell", "_row", "_column")
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(run, "id long, match_id long, score float")


def quarantine(rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows of ``(id, vector)``, and the others with the reason; repeats of an id keep none."""
    repeated = rows.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id", F.lit("duplicate id").alias("_repeat"))
    marked = rows.join(repeated, "id", "left").withColumn("problem", F.coalesce(vectors.problem(F.col("vector"), dimension), "_repeat")).drop("_repeat")
    return marked.filter("problem is null").drop("problem"), marked.filter("problem is not null").select("id", "problem")
