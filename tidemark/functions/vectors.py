"""Vector arithmetic on ``array<double>`` columns: evaluated in the JVM, or (``..._rows``) for whole batches of rows at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: first element of a vector that has not been computed yet.
MISSING_MARK = -10.0


def as_vector(values: Sequence[float]) -> Column:
    """Literal vector."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of element products in element order."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    # The length is an array argument, so it is computed once and not per element.
    lengths = F.array_repeat(norm(a), F.size(a))
    return F.zip_with(a, lengths, lambda x, n: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    a = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    b = (F.col(b) if isinstance(b, str) else b).cast("array<double>")
    similarity = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), similarity)


def missing_to_null(vector: Column | str) -> Column:
    """NULL for the stored "not embedded yet" vector."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.when(F.get(vector, F.lit(0)) == F.lit(MISSING_MARK), F.lit(None)).otherwise(vector)


# -- whole batches ---------------------------------------------------------------------------


def matrix(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of a matrix, and which of them have ``width`` elements (by default the longest one's), none NULL.

    All other rows are zero.
    """
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 0) if width is None else width
    there = sizes == width
    flat = (vectors if there.all() else vectors.filter(pa.array(there))).flatten()
    missing = None if not flat.null_count else flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
    found = flat.to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(int(there.sum()), width)
    if there.all() and missing is None:
        return found, there
    rows = np.zeros((len(vectors), width))
    rows[there] = found
    if missing is not None:
        there[np.flatnonzero(there)[missing]] = False
        rows[~there] = 0.0
    return rows, there


def _by_width(a: pa.Array, b: pa.Array):
    """(rows, matrix of a, matrix of b) for each width that rows of both have in full."""
    sizes = a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes >= 0]).tolist():
        (x, mine), (y, others) = matrix(a, width), matrix(b, width)
        both = mine & others
        yield (slice(None), x, y) if both.all() else (np.flatnonzero(both), x[both], y[both])


def dot_rows(a: Column, b: Column) -> Column:
    """``dot``, a batch of rows at once."""

    @F.arrow_udf(T.DoubleType())
    def dots(a: pa.Array, b: pa.Array) -> pa.Array:
        out, known = np.zeros(len(a)), np.zeros(len(a), bool)
        for rows, x, y in _by_width(a, b):
            out[rows], known[rows] = np.einsum("ij,ij->i", x, y), True
        return pa.array(out, mask=~known)

    return dots(a, b)


def cosine_rows(a: Column, b: Column) -> Column:
    """``cosine``, a batch of rows at once."""

    @F.arrow_udf(T.DoubleType())
    def cosines(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for rows, x, y in _by_width(a, b):
            lengths = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
            out[rows] = np.where(lengths == 0, 0.0, np.einsum("ij,ij->i", x, y) / np.where(lengths == 0, 1.0, lengths))
        known = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(out, mask=~known)

    return cosines(a.cast("array<double>"), b.cast("array<double>"))


def unit_rows(a: Column) -> Column:
    """``unit``, a batch of rows at once."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def units(a: pa.Array) -> pa.Array:
        sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(ends[-1])
        for rows, x, _ in _by_width(a, a):
            lengths = np.sqrt((x * x).sum(axis=1))[:, None]
            starts = ends[:-1][rows]
            out[(starts[:, None] + np.arange(x.shape[1])).ravel()] = np.where(lengths == 0, 0.0, x / np.where(lengths == 0, 1.0, lengths)).ravel()
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=a.is_null())

    return units(a)
