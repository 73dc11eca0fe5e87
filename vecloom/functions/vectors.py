"""Vector kernels: as Columns over ARRAY<FLOAT|DOUBLE>, and as NumPy over blocks."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class VectorError(ValueError):
    """A vector, code or name that an operator refuses."""


class Metric(Enum):
    """How near two vectors are; L2 is squared and the only one of which less is better."""

    DOT = "dot"
    COSINE = "cosine"
    L2 = "l2"

    @classmethod
    def parse(cls, name: str) -> "Metric":
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise VectorError(f"unknown metric {name!r}: dot, cosine or l2") from None

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return cosine_of(a, b, norm(a) * norm(b))


def cosine_of(a: Column, b: Column, size: Column) -> Column:
    """The cosine, given the product of both lengths."""
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def score(a: Column, b: Column, metric: Metric) -> Column:
    return {Metric.DOT: dot, Metric.COSINE: cosine, Metric.L2: l2_squared}[metric](a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0))))


def score_blocks(queries: np.ndarray, vectors: np.ndarray, metric: Metric) -> np.ndarray:
    """(queries, vectors) scores in double precision."""
    dots = queries @ vectors.T
    if metric is Metric.DOT:
        return dots
    q2, v2 = (queries * queries).sum(1)[:, None], (vectors * vectors).sum(1)[None, :]
    if metric is Metric.L2:
        return np.maximum(q2 - 2 * dots + v2, 0.0)
    size = np.sqrt(q2 * v2)
    return np.where(size == 0, 0.0, dots / np.where(size == 0, 1.0, size))


def matrix(column, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as a float64 matrix; every vector must have the same length."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(column.flatten(), np.float64)
    if not len(column):
        return np.empty((0, dim or 0))
    if len(flat) != len(column) * (dim or len(flat) // len(column)):
        raise VectorError("vectors differ in dimension")
    return flat.reshape(len(column), -1)
