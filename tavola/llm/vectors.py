"""Integer vectors: what the operators on vector tables share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
LARGEST = 2.0 ** 60      # squared length from which on sums of products may not fit in 64 bits


def integer_rows(vectors: DataFrame, vector_col: str, *kept: Column, scale: float = SCALE,
                 dim: int | None = None) -> DataFrame:
    """The columns ``kept`` and ``vector``, array<long> of floor(scale * component).

    Left out: null vectors, those with a null or non-finite component, those of
    another length than ``dim`` where it is given, and those whose squared integer
    length is ``LARGEST`` or more."""
    real = F.transform(F.col("_vector"), lambda x: x * scale)
    square = F.aggregate("_real", F.lit(0.0), lambda s, x: s + x * x)
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(*kept, F.col(vector_col).cast("array<double>").alias("_vector")).where("_vector IS NOT NULL")
    if dim is not None:
        rows = rows.where(F.size("_vector") == dim)
    rows = rows.where(finite).withColumn("_real", real).where(square < LARGEST)
    names = [c for c in rows.columns if c not in ("_vector", "_real")]
    return rows.select(*names, F.transform("_real", lambda x: F.floor(x)).alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal length as a matrix of 64-bit integers."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return (np.concatenate(flat) if flat else np.empty(0, np.int64)).astype(np.int64, copy=False).reshape(len(column), dim)
