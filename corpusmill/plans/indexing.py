"""Exact global positions without a single-task window.

``row_number() over (order by ...)`` without ``partitionBy`` moves every row
into one task.  ``dense_index`` range-partitions and sorts the rows, writes
them with their position inside their partition to the shared folder (Parquet,
survives executor loss), counts rows per partition (one small row each), turns
the counts into offsets and adds them up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import scratch_table


def dense_index(df: DataFrame, order_cols, index_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Add ``index_col`` = 0-based position in the total order ``order_cols``.

    ``order_cols`` must be unique (add a tie key).  The input is evaluated
    once: range partitioning samples a written copy of it, so ``df`` should
    hold only the columns the result needs."""
    order_cols = list(order_cols)
    base = scratch_table(df, "index-input")
    parts = [num_partitions] if num_partitions else []
    row = F.monotonically_increasing_id()  # (partition << 33) + row number inside it
    ranged = (base.repartitionByRange(*parts, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_row", row))
    ranged = scratch_table(ranged.withColumn("_part", F.shiftright("_row", 33))
                           .withColumn("_local", F.col("_row") - F.shiftleft(F.col("_part"), 33)).drop("_row"), "index")
    # one row per non-empty partition; bounded by the partition count
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_offset"))
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn(index_col, (F.col("_offset") + F.col("_local")).cast("bigint"))
            .drop("_part", "_offset", "_local"))


def ordered_chunks(df: DataFrame, order: list[str], chunk: int) -> DataFrame:
    """``df`` with ``_chunk``, a number that never falls along ``order`` and
    that at most ``chunk`` rows share.  The rows are range-partitioned and sorted
    by all of ``order``; a chunk is a run of positions inside a partition, so it
    holds no more rows when the first columns repeat or their values lie close.

    ``order`` must tell apart all rows that differ, so that a task that runs
    again numbers them as before; two readers of the numbers need a written
    table."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # partition number in the high bits, position inside the partition below
    return rows.withColumn("_chunk", F.floor(F.monotonically_increasing_id() / chunk))
