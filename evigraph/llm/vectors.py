"""What the two vector operators share: valid vectors, classes of equal ones, and Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import whole_id


def is_valid(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def keyed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id, vec, k1, k2 and ok; equal vectors share the 128-bit key (k1, k2)."""
    rows = vectors.select(whole_id(vectors, id_col).alias("id"), F.col(vec_col).alias("vec"))
    return rows.select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"), (is_valid(F.col("vec")) & F.col("id").isNotNull()).alias("ok"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
