"""Running totals per key that survive a hot key.

A window ``partitionBy(user).orderBy(ts)`` sends all of one user's rows to
one task.  ``running_totals`` splits every key's rows into time chunks:

1. per (key, chunk) totals - one row per chunk, map-side combined;
2. per key, a prefix over its chunk rows (small: one row per chunk);
3. the prefixes are joined back on (key, chunk) and a window partitioned by
   (key, chunk) finishes the running value inside each chunk.

A hot key therefore spreads over as many tasks as it has chunks.  The result
equals the single window exactly, because chunks are monotone in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunk(df: DataFrame, ts: str, unit: str, size: int) -> Column:
    """A chunk key that never decreases along ``ts``: ``floor(ts / size)`` for
    numbers, ``date_trunc`` (whose result is a TIMESTAMP) for times.  A
    TIMESTAMP_NTZ is truncated as text of its wall-clock time, so that no time
    zone takes part and no clock change can reorder rows."""
    kind = df.schema[ts].dataType.typeName()
    if kind == "timestamp_ntz":
        wide = {"year": 4, "month": 7, "day": 10, "hour": 13, "minute": 16, "second": 19}[unit]
        return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss").substr(1, wide)
    if kind.startswith("timestamp") or kind == "date":
        return F.date_trunc(unit, F.col(ts))
    return F.floor(F.col(ts) / size).cast("bigint")


def running_totals(df: DataFrame, by, ts: str, tie: str, sums: dict[str, Column] | None = None,
                   maxes: dict[str, Column] | None = None, unit: str = "hour", size: int = 1024) -> DataFrame:
    """Add running (inclusive) sums and maxima over rows ordered by
    (ts, tie) within ``by``.  Flag columns must not be null.  Chunks are
    ``unit`` periods for a timestamp order column, ``size`` wide for a
    numeric one."""
    by = [by] if isinstance(by, str) else list(by)
    sums, maxes = dict(sums or {}), dict(maxes or {})
    chunk = _chunk(df, ts, unit, size)
    base = df.withColumn("_chunk", chunk)
    for k, v in sums.items():
        base = base.withColumn(f"_s_{k}", v.cast("bigint"))
    for k, v in maxes.items():
        base = base.withColumn(f"_m_{k}", v)
    per_chunk = base.groupBy(*by, "_chunk").agg(
        *[F.sum(f"_s_{k}").alias(f"_cs_{k}") for k in sums],
        *[F.max(f"_m_{k}").alias(f"_cm_{k}") for k in maxes])
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *by, "_chunk",
        *[F.coalesce(F.sum(f"_cs_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.max(f"_cm_{k}").over(before).alias(f"_p_{k}") for k in maxes])
    rows = Window.partitionBy(*by, "_chunk").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(offsets, [*by, "_chunk"])
    for k in sums:
        out = out.withColumn(k, (F.col(f"_o_{k}") + F.sum(f"_s_{k}").over(rows)).cast("bigint"))
    for k in maxes:
        inner = F.max(f"_m_{k}").over(rows)
        out = out.withColumn(k, F.when(F.col(f"_p_{k}").isNull(), inner).otherwise(F.greatest(F.col(f"_p_{k}"), inner)))
    drop = ["_chunk"] + [f"_{p}_{k}" for k in sums for p in ("s", "o")] + [f"_{p}_{k}" for k in maxes for p in ("m", "p")]
    return out.drop(*drop)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that costs far more per byte than a shuffle (regular
    expressions over texts): rows that stand in fewer partitions than there are
    cores, as those of few files or row groups do, are dealt out evenly.  A
    table of many files is left as it is, without looking at it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= 2 * cores:
        return df
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(2 * cores) if used < cores else df
