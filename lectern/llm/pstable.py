"""Hashing of vectors by quantised random projections, p-stable for the Euclidean distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """False for vectors that are null, empty, zero, or hold null, NaN or infinite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


class Projections:
    """Tables of width-quantised projections for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, projections: int, width: float):
        rng = np.random.default_rng([dim, tables, projections])
        self.a = rng.normal(size=(tables * projections, dim)) / width
        self.b = rng.uniform(size=tables * projections)
        self.shape = tables, projections
        odd = rng.integers(1 << 62, 1 << 63, (tables, projections), np.uint64) | np.uint64(1)
        self.odd, self.base = odd.view(np.int64), rng.integers(-(1 << 62), 1 << 62, tables, np.int64) + dim

    def positions(self, units: np.ndarray) -> np.ndarray:
        """Rows x tables x projections, in units of the width."""
        return (units @ self.a.T + self.b).reshape(len(units), *self.shape)

    def buckets(self, positions: np.ndarray) -> np.ndarray:
        """Rows x tables: 64-bit names of the buckets."""
        with np.errstate(over="ignore"):
            return (np.floor(positions).astype(np.int64) * self.odd).sum(2) + self.base


def by_dimension(column: pa.ListArray):
    """(dimension, indices, matrix) for the vectors of each dimension; no vector is null or holds null."""
    ends = np.cumsum(sizes := np.diff(np.asarray(column.offsets)))
    flat = np.asarray(column.flatten(), np.float64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        if len(at) == len(sizes):
            yield int(d), at, flat.reshape(len(at), d)
        else:
            yield int(d), at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def same_bucket(distance: float, width: float) -> float:
    """Probability that one projection puts two vectors at this distance into the same interval."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(distance: float, width: float, projections: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - same_bucket(distance, width) ** projections))
