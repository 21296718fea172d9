"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BROADCAST_BYTES = 16 << 20


def measured_bytes(df: DataFrame) -> int:
    """16 bytes per row and column plus the bytes of every string (one
    distributed aggregate; no row leaves its task)."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0])


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it measures at most ``limit`` bytes; a
    larger one is left to the shuffle join, which gives the same rows."""
    return F.broadcast(df) if measured_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df
