"""Exact nearest neighbours by cosine, visiting only what can still beat the best match so far.

The catalog is dealt to cells, each vector to the nearest of a bounded number of pivots, and cells to blocks
of bounded size; a cell's vectors lie in the order of their angle to the pivot.  First every query looks into
the block of its own cell, which gives it a first match.  Then it goes to the blocks that hold a cell which can
beat it: by the triangle inequality of angles, no vector of a cell is nearer than the query's angle to the
pivot less the cell's radius, and in a cell only vectors count whose angle to the pivot differs from the
query's by less than the angle of the best match.  Every visit shrinks that angle further, nearest cells first.

Nothing is replicated to every block: a query is sent where it can gain, and a block is copied only if more
queries come to it than one task should hold.  Neither side passes through the driver, which holds the pivots
and a few numbers a block.  On vectors without any clusters all blocks may have to be visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.operators.similarity import STEP, met, paired, scores, unit_rows
from mergewell.workspace import discard, materialize

#: Most pivots, bytes of a block of the catalog as float64, and of the queries that a task holds.
PIVOTS, BLOCK_BYTES, QUERY_BYTES = 1 << 10, 32 << 20, 16 << 20
#: A catalog of at most this size is one block, which every query is compared with.
DIRECT_BYTES = 8 << 20
#: Angles are kept apart by this much, so that rounding never rules a vector out.
SLACK = 1e-3
FOUND = "match_id long, score float, compared long"


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit_rows(column) if len(column) else np.zeros((0, dimension))


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def sound(column: Column) -> Column:
    """Vectors that have a score: there, and without NULL, NaN or infinity."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return column.isNotNull() & ~F.exists(column, bad)


class Best:
    """The best match of each of a task's queries so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, score: np.ndarray, exclude_self: bool):
        self.ids, self.rows, self.exclude_self = ids, rows, exclude_self
        self.score = score.copy()
        self.match = np.full(len(ids), -1, np.int64)
        self.found = np.zeros(len(ids), bool)
        self.compared = np.zeros(len(ids), np.int64)
        self.zero = ~rows.any(axis=1)  # no direction: every score is 0, and angles mean nothing

    def reach(self) -> np.ndarray:
        """The angle within which a vector can still beat or equal the best match."""
        return np.where(self.zero | ~np.isfinite(self.score), np.pi, np.arccos(np.clip(self.score.astype(np.float64), -1, 1))) + SLACK

    def visit(self, which: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Compare the queries ``which``, ``own`` away from the pivot, with a cell's rows, which are ``at`` (sorted) away from it."""
        order = np.argsort(own, kind="stable")
        which, own = which[order], own[order]
        reach = self.reach()[which]
        blind = reach > np.pi
        low, high = np.searchsorted(at, np.where(blind, -1, own - reach)), np.searchsorted(at, np.where(blind, 4, own + reach), "right")
        for i in range(0, len(which), STEP):
            part = which[i : i + STEP]
            a, b = int(low[i : i + STEP].min()), int(high[i : i + STEP].max())
            if a >= b:
                continue
            s = scores(self.rows[part], rows[a:b])
            if self.exclude_self:
                s[self.ids[part, None] == ids[None, a:b]] = -np.inf
            self.compared[part] += b - a
            top = s.max(axis=1)
            first = np.where(s == top[:, None], ids[None, a:b], np.iinfo(np.int64).max).min(axis=1)  # ties: the smallest id
            better = np.isfinite(top) & ((top > self.score[part]) | ((top == self.score[part]) & (~self.found[part] | (first < self.match[part]))))
            done = part[better]
            self.score[done], self.match[done], self.found[done] = top[better], first[better], True


class Layout:
    """Pivots, and how cells are dealt to blocks."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, rows: int):
        self.pivots, self.radius = pivots, radius
        #: a cell is cut into parts of about ``rows`` vectors; parts of small cells share a block
        self.parts = np.maximum(1, -(-counts // rows))
        self.first = np.zeros(len(counts), np.int64)  # a cell's first block; its parts follow
        block, room = -1, 0
        for cell in self.order():
            if self.parts[cell] > 1 or counts[cell] > room or block < 0:
                block += 1
                room = rows if self.parts[cell] == 1 else 0
            self.first[cell] = block
            block += int(self.parts[cell]) - 1
            room -= int(counts[cell])
        self.blocks = block + 1

    def order(self) -> list[int]:
        """Cells so that neighbours follow each other: each after the one nearest to it."""
        left, out = set(range(1, len(self.pivots))), [0]
        near = self.pivots @ self.pivots.T
        while left:
            rest = np.fromiter(left, int)
            out.append(int(rest[near[out[-1], rest].argmax()]))
            left.remove(out[-1])
        return out

    def block_of(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cells] + (spread % self.parts[cells].astype(np.uint64)).astype(np.int64)


def direct(asked: DataFrame, others: DataFrame, exclude_self: bool, d: int) -> DataFrame:
    """The same as ``search`` for a catalog that is small enough to go to every task of the queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        best = Best(ids, matrix(left.column("vector"), d), np.full(len(ids), -np.inf, np.float32), exclude_self)
        if right.num_rows:
            other = matrix(right.column("other"), d)
            best.visit(np.arange(len(ids)), np.zeros(len(ids)), right.column("other_id").to_numpy(), other, np.zeros(len(other)))
        return pa.table({"id": left.column("id"), "match_id": pa.array(best.match, mask=~best.found), "score": pa.array(best.score, mask=~best.found), "compared": pa.array(best.compared)})

    right = others.select(F.col("id").alias("other_id"), F.col("vector").alias("other"))
    return paired(asked, right, ("id", "other_id"), run, f"id long, {FOUND}", ((asked.count(), d), (0, d)))  # one block, as its size was checked


def nearest(queries: DataFrame, catalog: DataFrame, exclude_self: bool = False) -> DataFrame:
    """``id, match_id, score`` for every row of ``queries (id, vector)``; see ``search``."""
    return search(queries, catalog, exclude_self).select("id", "match_id", "score")


def leave_one_out(catalog: DataFrame) -> DataFrame:
    """The nearest other product of every product."""
    return search(catalog, catalog, exclude_self=True, same=True).select("id", "match_id", "score")


def leave_one_out_named(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """``leave_one_out`` of ``catalog (id, identity)`` whose vectors go by identity: ``vectors (identity, vector)``, a row for each.

    Products of one identity have one vector, so identities are searched, each by its smallest id.  A product's
    nearest other is another of its own identity or its identity's nearest, whichever scores higher; ties go to
    the smallest id.
    """
    rows = catalog.select(F.col("id").cast("long").alias("id"), "identity")
    if not rows.groupBy("id").count().filter("count > 1 or id is null").isEmpty():  # such ids may have several vectors
        return leave_one_out(rows.join(vectors, "identity").select("id", "vector"))
    first = materialize(rows.groupBy("identity").agg(F.min("id").alias("first")), "first-of-identity")
    second = rows.join(first, "identity").filter("id > first").groupBy("identity").agg(F.min("id").alias("second"))
    own = first.join(second, "identity", "left").join(vectors, "identity")
    one = materialize(own.select("identity", F.col("first").alias("id"), "second", "vector"), "identities")

    def with_self(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("vector"), 0)
            same = np.array([scores(m[k : k + 1], m[k : k + 1])[0, 0] for k in range(len(m))], np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("identity"), pa.array(same)], ["identity", "same"])

    same = one.filter("second is not null").filter(sound(F.col("vector"))).select("identity", "vector").mapInArrow(with_self, "identity string, same float")
    found = leave_one_out(one.select("id", "vector")).select(F.col("id").alias("first"), "match_id", "score")
    known = one.select("identity", F.col("id").alias("first"), "second").join(found, "first").join(same, "identity", "left")
    known = materialize(known, "nearest-of-identity")
    rest = F.struct("score", (-F.col("match_id")).alias("to"))
    twin = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    mine = F.struct(F.col("same").alias("score"), (-twin).alias("to"))
    best = F.greatest(F.when(F.col("match_id").isNotNull(), rest), F.when(F.col("same").isNotNull(), mine))
    found = rows.join(known, "identity").withColumn("_best", best)
    return found.select("id", (-F.col("_best.to")).alias("match_id"), F.col("_best.score").alias("score"))


def search(queries: DataFrame, catalog: DataFrame, exclude_self: bool = False, pivots: int | None = None, same: bool = False) -> DataFrame:
    """``id, match_id, score, compared`` for every row of ``queries (id, vector)``; ``catalog`` is ``(id, vector)``.

    Scores are accumulated in double precision, cast to float32 and clamped; ties go to the smallest id.
    Vectors that are NULL, or have a NULL, NaN or infinite component, match nothing; a zero vector has score 0
    with everything.  Without any match ``match_id`` and ``score`` are NULL.  ``compared`` counts the vectors
    that a query was compared with.  ``pivots`` bounds the cells (by default the root of the catalog's size);
    it changes the work, never the result.  ``same``: both sides are the same rows, which are then placed once.
    """
    asked = queries.select(F.col("id").cast("long").alias("id"), "vector").filter(sound(F.col("vector")))
    others = catalog.select(F.col("id").cast("long").alias("id"), "vector").filter(sound(F.col("vector")))
    n, d = others.agg(F.count("*"), F.max(F.size("vector"))).first()
    whole = queries.select(F.col("id").cast("long").alias("id"))
    if not n or not d:
        return whole.select("id", F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("float").alias("score"), F.lit(0).cast("long").alias("compared"))
    if not pivots and 8 * n * d <= DIRECT_BYTES:
        return whole.join(direct(asked, others, exclude_self, d), "id", "left").withColumn("compared", F.coalesce("compared", F.lit(0).cast("long")))
    wanted = pivots or max(1, min(PIVOTS, math.isqrt(n)))
    sample = others.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
    centres = matrix(sample.column(0), d)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = angles(matrix(batch.column("vector"), d), centres)
            cell = found.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(found[np.arange(len(cell)), cell])], ["id", "vector", "cell", "angle"])

    inside = "id long, vector array<float>, cell int, angle double"
    cells = materialize(others.mapInArrow(placed, inside), "cells")
    counts, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect():  # one row a pivot
        counts[r["cell"]], radius[r["cell"]] = r["n"], r["far"]
    layout = Layout(centres, counts, radius, max(1, BLOCK_BYTES // (8 * d)))
    total = n if same else queries.count()
    cores = others.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(QUERY_BYTES // (8 * d), max(4 * STEP, -(-total // cores))))  # few blocks are copied for all cores

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = layout.block_of(batch.column("cell").to_numpy(), batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], ["id", "vector", "cell", "angle", "block"])

    right = cells.mapInArrow(dealt, inside + ", block long").select(F.col("id").alias("other_id"), F.col("vector").alias("other"), "cell", "angle", "block")
    own = cells if same else asked.mapInArrow(placed, inside)
    left = own.mapInArrow(dealt, inside + ", block long").select("id", "vector", "cell", "block", F.lit(None).cast("float").alias("score"))
    few = total <= most

    def together(left: DataFrame, run, schema: str) -> DataFrame:
        """``run`` on the queries of a block and its vectors; a block with many queries is copied for every ``most`` of them."""
        crowded = {} if few else {r["block"]: -(-r["count"] // most) for r in left.groupBy("block").count().filter(F.col("count") > most).collect()}  # at most a row a block
        copies = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in crowded.items() for x in kv]), F.col("block")), F.lit(1)) if crowded else F.lit(1)
        a = left.withColumn("_copy", F.pmod(F.xxhash64("id"), copies.cast("long")))
        b = right.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))
        groups = layout.blocks + sum(c - 1 for c in crowded.values())
        return met(a, b, ("block", "_copy"), groups).applyInArrow(run, schema)

    def compare(left: pa.Table, right: pa.Table, home: bool) -> tuple[Best, np.ndarray]:
        """The queries after a visit of the block: at ``home`` of their own cell, later of all others that they reach."""
        ids, score = left.column("id").to_numpy(), left.column("score").to_numpy(zero_copy_only=False).astype(np.float32)
        best = Best(ids, matrix(left.column("vector"), d), np.where(np.isnan(score), np.float32(-np.inf), score), exclude_self)
        right = right.sort_by([("cell", "ascending"), ("angle", "ascending")])
        at, cell, other = right.column("angle").to_numpy(), right.column("cell").to_numpy(), right.column("other_id").to_numpy()
        numbers, starts = np.unique(cell, return_index=True)
        ends = [*starts[1:], len(cell)]
        away = angles(best.rows, centres[numbers]) if len(numbers) else np.zeros((len(ids), 0))
        block, mine = left.column("block").to_numpy(), left.column("cell").to_numpy()
        visited = home | (layout.block_of(mine, ids) == block)  # its own cell's part in this block is home's
        nearest_first = np.argsort(away.min(axis=0) - radius[numbers]) if len(ids) else []
        for k in nearest_first:
            number, a, b = numbers[k], int(starts[k]), int(ends[k])
            hit = np.flatnonzero(mine == number if home else (away[:, k] - radius[number] <= best.reach()) & ~(visited & (mine == number)))
            if len(hit):
                best.visit(hit, away[hit, k], other[a:b], matrix(right.column("other").slice(a, b - a), d), at[a:b])
        return best, ids

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("vector", pa.list_(pa.float32())), ("cell", pa.int32()), ("match_id", pa.int64()), ("score", pa.float32()), ("compared", pa.int64()), ("blocks", pa.list_(pa.int64())))})
        best, ids = compare(left, right, home=True)
        reach, lists = best.reach(), []
        for i in range(0, len(ids), STEP):
            away = angles(best.rows[i : i + STEP], centres)
            near = (away - radius[None, :] <= reach[i : i + STEP, None]) & (counts > 0)[None, :]
            mine = left.column("cell").to_numpy()[i : i + STEP]
            near[np.arange(len(near)), mine] &= layout.parts[mine] > 1  # of its own cell only other parts are left
            for row in near:
                reached = np.flatnonzero(row)
                parts = layout.parts[reached]
                lists.append(np.unique(np.repeat(layout.first[reached] - np.cumsum(parts) + parts, parts) + np.arange(parts.sum())))
        sizes = np.array([len(x) for x in lists])
        return pa.table(
            {
                "id": left.column("id"), "vector": left.column("vector"), "cell": left.column("cell"),
                "match_id": pa.array(best.match, mask=~best.found), "score": pa.array(best.score, mask=~best.found), "compared": pa.array(best.compared),
                "blocks": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(lists).astype(np.int64))),
            }
        )

    def then(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("match_id", pa.int64()), ("score", pa.float32()), ("compared", pa.int64()))})
        best, _ = compare(left, right, home=False)
        return pa.table({"id": left.column("id"), "match_id": pa.array(best.match, mask=~best.found), "score": pa.array(best.score, mask=~best.found), "compared": pa.array(best.compared)})

    begun = materialize(together(left, first, f"id long, vector array<float>, cell int, {FOUND}, blocks array<long>"), "first-matches")
    onward = begun.select("id", "vector", "cell", F.explode("blocks").alias("block"), "score")
    found = together(onward, then, f"id long, {FOUND}").unionByName(begun.select("id", "match_id", "score", "compared"))
    best = F.max_by(F.struct("match_id", "score"), F.when(F.col("match_id").isNotNull(), F.struct("score", -F.col("match_id"))))
    out = materialize(found.groupBy("id").agg(best.alias("m"), F.sum("compared").alias("compared")).select("id", "m.*", "compared"), "nearest")
    discard(begun, cells)
    return whole.join(out, "id", "left").withColumn("compared", F.coalesce("compared", F.lit(0).cast("long")))
