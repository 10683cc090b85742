"""Vectors: distance, normalisation and means.

Spark has no distance between arrays.  Searches compute it in numpy over Arrow batches
(``operators.knn``); the expressions here serve single values and small jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_normalise(v: Column | str) -> Column:
    """Unit length, in double precision; a zero vector stays as it is."""
    c = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(_sum(F.transform(c, lambda x: x * x)))
    return F.when(norm == 0, c).otherwise(F.transform(c, lambda x: x / norm))


def matrix(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as a matrix in double precision, and the rows it holds.

    Vectors that are null, hold a null, or are of another length than ``dimensions`` (by default the most frequent one) are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if dimensions is None:
        dimensions = int(np.bincount(sizes[sizes > 0]).argmax()) if (sizes > 0).any() else 0
    ok = (sizes == dimensions) & (dimensions > 0)
    kept = column.filter(pa.array(ok))
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, dimensions))
    whole = ~np.isnan(flat).any(axis=1)
    return flat[whole], np.flatnonzero(ok)[whole]


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The component-wise mean of each key's vectors: map-side sums by (key, place), then one array."""
    by_place = vectors.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return by_place.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def normalise(v: list[float]) -> list[float]:
    a = np.asarray(v, np.float64)
    n = float(np.sqrt((a * a).sum()))
    return v if n == 0 else (a / n).tolist()


def mean(vectors: list[list[float]]) -> list[float]:
    return np.mean(np.asarray(vectors, np.float64), axis=0).tolist()
