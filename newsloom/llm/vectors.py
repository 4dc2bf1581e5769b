"""Reading embedding vectors: which take part, and their bytes in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_valid(vector: Column) -> Column:
    """Neither null nor empty nor all zero, and every component is a finite number."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    nonzero = F.exists(vector, lambda x: F.coalesce(value(x), F.lit(0.0)) != 0.0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & nonzero, F.lit(False))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Components as little-endian doubles."""
    return vectors.map(lambda v: np.asarray(v, dtype="<f8").tobytes())


def stack(values: pd.Series) -> np.ndarray:
    """A matrix from the bytes of vectors of one length."""
    if not len(values):
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1)


def unit_rows(values: pd.Series) -> np.ndarray:
    """Vectors scaled to length 1, first by their largest component, so that no square over- or underflows."""
    matrix = stack(values)
    if not len(matrix):
        return matrix
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def cosine(a: bytes, b: bytes) -> float:
    """In double precision, of the original components but for the scale of each vector."""
    x, y = (np.frombuffer(v, "<f8") for v in (a, b))
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


def valid_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, vector, dim)`` of the vectors that take part."""
    vector = F.col("embedding").cast("array<double>")
    valid = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(is_valid(F.col("v")))
    return valid.select("vec_id", to_bytes("v").alias("vector"), F.size("v").alias("dim"))
