"""Vectors as whole numbers, and exact arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 1 << 53
"""Whole numbers below this are exact as doubles."""


def is_complete(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False))


def whole_numbers(vector: Column, scale: int) -> Column:
    """Components times `scale`, rounded down; a value beyond 32 bits is an error, not a wrong number."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))


def of_one_length(rows: DataFrame, numbers: str, length: int | None) -> DataFrame:
    """Rows whose vector has the given number of components."""
    return rows.filter(F.size(numbers) == F.lit(-1 if length is None else length))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of whole numbers, one row per list."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column, one list per row."""
    rows, width = values.shape
    ends = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two whole-number matrices, exact at any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between all rows of two whole-number matrices, exact at any size."""
    square = lambda m: np.einsum("ij,ij->i", m, m)
    if a.size and b.size and 4 * a.shape[1] * max(int(np.abs(a).max()), int(np.abs(b).max())) ** 2 >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
        square = lambda m: (m * m).sum(axis=1)
        return square(a)[:, None] - 2 * (a @ b.T) + square(b)[None, :]
    return square(a)[:, None] - 2 * products(a, b) + square(b)[None, :]
