"""Decisions that depend on how large a table really is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def is_small(
    df: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> bool:
    """Counts rows and bytes in one aggregation, which ships one row per task.

    Arrays, maps and structs are not measured, so a table that has any is not small.
    """
    width = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return False
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            width = width + F.lit(16)
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def require_small(df: DataFrame, what: str, **bounds: int) -> DataFrame:
    """``df`` if it may be sent to every task; else an error, instead of a cut or another way."""
    if not is_small(df, **bounds):
        raise ValueError(f"{what} is sent to every task and may have {MAX_BROADCAST_ROWS} rows and {MAX_BROADCAST_BYTES >> 20} MB at most")
    return df
