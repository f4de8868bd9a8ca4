"""Vector columns: validity tests and Arrow-batched similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("cosine", "dot", "l2")

#: Scores are rounded so that ties, and with them ranks, do not depend on how
#: the rows happen to be partitioned.
SCORE_DIGITS = 6


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def as_vector(values: Column) -> Column:
    return values.cast("array<float>")


def dimension(vector: Column) -> Column:
    """Length of the vector; NULL for a NULL vector."""
    return F.when(vector.isNotNull(), F.size(vector))


def _norms(vectors: pa.Array) -> pa.Array:
    lengths = pc.min_max(vectors.value_lengths()).as_py()
    if vectors.null_count == 0 and lengths["min"] is not None and lengths["min"] == lengths["max"]:
        values = np.linalg.norm(to_matrix(vectors), axis=1)
    else:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = pc.fill_null(vectors.value_lengths(), 0).to_numpy(zero_copy_only=False)
        sums = np.zeros(len(vectors))
        if len(flat):
            ends = np.cumsum(lengths)
            some = lengths > 0
            sums[some] = np.add.reduceat(flat * flat, (ends - lengths)[some])
        values = np.sqrt(sums)
        values[pc.is_null(vectors).to_numpy(zero_copy_only=False)] = np.nan
    return pa.array(values, type=pa.float64(), from_pandas=True)


def norm(vector: Column) -> Column:
    """Euclidean length in double; NULL for a NULL vector or one with NULL or NaN inside.

    Arrow-batched like `similarity_to`, and marked so that a filter on it does
    not compute it twice.
    """
    return F.arrow_udf(_norms, T.DoubleType()).asNondeterministic()(vector)


def _digests(vectors: pa.Array) -> pa.Array:
    if len(vectors) == 0:
        return pa.array([], type=pa.binary())
    rows = to_matrix(vectors).astype(np.float32) + np.float32(0.0)  # -0.0 becomes 0.0
    return pa.array([hashlib.sha256(row.tobytes()).digest() for row in rows], type=pa.binary())


def vector_digest(vector: Column) -> Column:
    """SHA-256 of a valid vector's components; vectors of one length, equal if and only if alike."""
    return F.arrow_udf(_digests, T.BinaryType()).asNondeterministic()(vector)


def searchable_vectors(table: DataFrame, vector: str, dim: int | None = None, norm_column: str = "norm") -> DataFrame:
    """Rows whose vector can be searched, with its norm added.

    Left out are NULL vectors, vectors with NULL or NaN inside, zero vectors
    and, where ``dim`` is given, other lengths.
    """
    rows = table.filter(F.col(vector).isNotNull() if dim is None else F.size(vector) == dim)
    measured = rows.withColumn(norm_column, norm(F.col(vector)))
    return measured.filter((F.col(norm_column) > 0) & (F.col(norm_column) < float("inf")))


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, 0))
    lengths = pc.min_max(column.value_lengths()).as_py()
    if column.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("vectors are NULL or differ in length; give the dimension to leave such rows out")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths != 0)


def closeness(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """All scores between the rows of two matrices, larger meaning closer (L2 is negated)."""
    if metric == "cosine":
        return unit_rows(left) @ unit_rows(right).T
    products = left @ right.T
    if metric == "dot":
        return products
    squares = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * products
    return -np.sqrt(np.maximum(squares, 0.0))


def square_error(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far off a squared distance by the product of two matrices can be, for each row of ``left``.

    The squares and the product are each off by a few roundings per component,
    in proportion to the squared lengths.
    """
    lengths = (left**2).sum(axis=1) + (right**2).sum(axis=1).max(initial=0.0)
    return 4 * np.finfo(np.float64).eps * (left.shape[1] + 4) * lengths


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in pairs, by difference."""
    return np.sqrt(((left - right) ** 2).sum(axis=1))


def rounded(values: np.ndarray) -> np.ndarray:
    return np.round(values, SCORE_DIGITS) + 0.0


def similarity_to(query: Sequence[float], metric: str = "cosine"):
    """Column function ``vector -> score`` against one fixed query vector.

    An Arrow function: a batch of vectors is one matrix product, about three
    times faster than folding the arrays with higher-order functions.
    """
    check_metric(metric)
    target = np.asarray(query, dtype=np.float64)

    def score(vectors: pa.Array) -> pa.Array:
        matrix = to_matrix(vectors)
        if len(matrix) == 0:
            return pa.array([], type=pa.float64())
        if metric == "l2":
            values = np.linalg.norm(matrix - target[None, :], axis=1)
        else:
            values = closeness(matrix, target[None, :], metric)[:, 0]
        lengths = np.linalg.norm(matrix, axis=1)
        values[~(lengths > 0) | ~np.isfinite(lengths)] = np.nan  # not searchable, as in an index
        return pa.array(rounded(values), type=pa.float64(), from_pandas=True)

    return F.arrow_udf(score, "double")
