"""Embedding columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite_vector(vector: str) -> Column:
    """Whether an array column is not null and holds finite numbers only."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """Lists of ``dim`` numbers each as an (n, dim) matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)
