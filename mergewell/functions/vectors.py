"""Vector arithmetic on ``array<float>`` columns: double accumulation, float32 scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def problem(v: Column, dimension: int | None = None) -> Column:
    """Why a vector can't be used, or NULL."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = F.when(v.isNull() | (F.size(v) == 0), "empty")
    if dimension is not None:
        out = out.when(F.size(v) != dimension, "dimension")
    return out.when(F.exists(v, bad), "not finite").when(norm(v) == 0, "zero")


def unit(v: Column) -> Column:
    """The vector over its norm, NULL where it has none."""
    length = norm(v)
    return F.when(problem(v).isNull(), F.transform(v, lambda x: (x.cast("double") / length).cast("float")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; NULL for vectors of different length or without one."""
    value = dot(a, b) / (norm(a) * norm(b))
    usable = (F.size(a) == F.size(b)) & problem(a).isNull() & problem(b).isNull()
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def kind(score: Column, threshold: float) -> Column:
    """duplicate iff a match was found and its float32 score reaches the threshold."""
    reached = score.isNotNull() & (score.cast("float") >= F.lit(threshold).cast("float"))
    return F.when(reached, "duplicate").otherwise("novel")
