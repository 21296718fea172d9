"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import scratch_table

# a side of a join is broadcast only when its measured payload is below this
BROADCAST_MAX_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spill_table(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage at files that survive a lost executor.  ``few``: a
    light table made by many tasks; a shuffle of its own lets AQE write it in
    as few files as its size asks for."""
    return scratch_table(df.hint("rebalance") if few else df, name)


# rows of texts that travel to Python at a time
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches limited to TEXT_ROWS rows: at
    the default of 10,000 the batches of a few tasks fill an executor's
    memory outside the heap."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= TEXT_ROWS:
        conf.set(_BATCH, str(TEXT_ROWS))
    return df


def payload_bytes(df: DataFrame, *text_cols: str) -> int:
    """Measured size of a table: 16 bytes a row plus the length of its texts
    (one distributed aggregate)."""
    size = F.lit(16)
    for c in text_cols:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0])


def small_side(df: DataFrame, *text_cols: str, limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is below ``limit``;
    otherwise unchanged, and the join shuffles (AQE splits skewed keys).  Both
    ways give the same rows."""
    return F.broadcast(df) if payload_bytes(df, *text_cols) <= limit else df
