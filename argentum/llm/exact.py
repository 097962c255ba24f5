"""Whole-number vectors: exact squared distances by matrix products, with Python's integers beyond 2**53.

A double holds every whole number below 2**53.  Where all partial results of a matrix product
stay below that, the order of its additions doesn't matter and it is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

EXACT = float(1 << 53)
#: The largest long; larger results are given as this.
LONGEST = (1 << 63) - 1


def numbers(vectors: DataFrame, vector_col: str) -> Column:
    """The vector column as array<float> if it is one, else as array<double>."""
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")


def whole(lists: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(scale * x)) of the vectors of length ``dim`` without null or non-finite numbers.

    scale is a power of two, so that the product is exact.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = pc.list_flatten(lists.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(flat.reshape(-1, dim) * scale)
    good = np.isfinite(x).all(1)  # nulls are read as NaN
    return rows[good], x[good]


def integers(x: np.ndarray) -> np.ndarray:
    """A matrix of whole numbers as Python integers."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel()]
    return out


def tops(x: np.ndarray) -> np.ndarray:
    """The largest magnitude in each row, as a double."""
    return np.abs(x).max(1, initial=0).astype(np.float64)


def expanded(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|x|² - 2 x·c + |c|² for all pairs of rows."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (doubles) to those of c (Python integers).

    Doubles where every sum of magnitudes stays below 2**53; otherwise Python's integers, and then
    only the pairs with a large row on either side are computed with them.
    """
    dim, top_x, top_c = x.shape[1], tops(x), tops(c)
    if dim * (top_x.max(initial=0) + top_c.max(initial=0)) ** 2 < EXACT:
        return expanded(x, c.astype(np.float64))
    near_x, near_c = (np.flatnonzero(4.0 * dim * t * t < EXACT) for t in (top_x, top_c))
    out = np.empty((len(x), len(c)), object)
    if len(near_x) and len(near_c):
        near = expanded(x[near_x], c[near_c].astype(np.float64))
        out[np.ix_(near_x, near_c)] = near.astype(np.int64).astype(object)
    far_c = np.setdiff1d(np.arange(len(c)), near_c)
    for rows, columns in ((np.setdiff1d(np.arange(len(x)), near_x), np.arange(len(c))), (near_x, far_c)):
        if len(columns):
            for i in rows:
                gaps = integers(x[i : i + 1]) - c[columns]
                out[i, columns] = (gaps * gaps).sum(1)
    return out


def sums(x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum of rows as Python integers) for each of n groups."""
    count = np.bincount(of, minlength=n).astype(object)
    if len(x) * tops(x).max(initial=0) < EXACT:
        return count, integers(np.stack([np.bincount(of, column, n) for column in x.T], 1)) if len(x) else np.zeros((n, x.shape[1]), int).astype(object)
    total = np.zeros((n, x.shape[1]), int).astype(object)
    np.add.at(total, of, integers(x))
    return count, total


def means(count: np.ndarray, total: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Component by component floor(sum / count); groups without rows keep what they had."""
    return np.array([[s // n for s in row] if n else list(old) for n, row, old in zip(count, total, before)], object).reshape(before.shape)


def long(value) -> int:
    return min(int(value), LONGEST)
