"""Shortest-n selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def total_length(df: DataFrame, cols=None) -> Column:
    """Sum of string lengths of ``cols`` (null, missing or non-string count 0);
    ``cols=None`` sums every string column (C2)."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    names = [c for c in (cols if cols else sorted(string_cols)) if c in string_cols]
    if not names:
        return F.lit(0).cast("bigint")
    parts = [F.coalesce(F.length(F.col(c)), F.lit(0)).cast("bigint") for c in names]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


# keys that one aggregate may hold, and how finely a range of keys is counted
KEYS_AT_ONCE = 10_000
CUTS = 64


def kth_smallest(keys: DataFrame, k: int, n: int):
    """The ``k``-th smallest (from 1) of the ``n`` keys in the one column of
    ``keys``: an order-statistic selection.

    While the range in question holds more than ``KEYS_AT_ONCE`` keys, cut
    points (keys picked by hash, so any order type will do) divide it, one
    counting pass tells the interval that holds the key, and the range shrinks
    to it; about log(n) / log(CUTS) passes over keys alone.  Nothing is sorted,
    shuffled by key or written."""
    name, rounds = keys.columns[0], 0
    key = F.col(name)
    while n > KEYS_AT_ONCE:
        rounds += 1
        picked = F.pmod(F.xxhash64(F.lit(rounds), key), F.lit(max(1, n // (2 * CUTS)))) == 0
        cuts = sorted(r[0] for r in keys.filter(picked).limit(4 * CUTS).collect())[::2]  # any keys are right as cuts
        interval = sum((F.when(key > c, 1).otherwise(0) for c in cuts), F.lit(0))
        counts = keys.groupBy(interval.alias("_i")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy("_i").collect()
        for c in counts:
            if k <= c.n:
                break
            k -= c.n
        if c.lo == c.hi:
            return c.lo
        keys, n = keys.filter(key.between(c.lo, c.hi)), c.n
    return keys.agg(F.sort_array(F.collect_list(key)).alias("k")).first()["k"][k - 1]


def _cut(scored: DataFrame, n: int, tie: str):
    """(length, key): rows shorter than ``length`` are in, and those of that
    length up to ``key`` (None: all of them); None if there are at most ``n``
    rows.  Rows are counted per length (partial counts; as many rows as there
    are lengths), then the key is selected among those of the cut length."""
    counts = scored.groupBy("_len").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_len").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("_upto", upto).filter(F.col("_upto") >= n).agg(F.min(F.struct("_len", "_n", "_upto")).alias("c")).first()["c"]
    if at is None:
        return None
    wanted = n - (at["_upto"] - at["_n"])
    if wanted == at["_n"]:
        return at["_len"], None
    return at["_len"], kth_smallest(scored.filter(F.col("_len") == at["_len"]).select(tie), wanted, at["_n"])


def shortest_n(df: DataFrame, n: int | None, cols=("solution",), tie: str = "sample_id",
               length_col: str | None = None, observed: Observation | None = None) -> DataFrame:
    """The ``n`` rows with the smallest total length; ties by ``tie``,
    which must be unique.

    ``n`` null or 0 means no limit; ``n`` >= rows returns every row.  The cut
    is found from counts per length and the keys at the cut length; full rows
    are only filtered, never sorted, moved or merged in one task.  ``observed``
    receives the rows of ``df`` as ``n_input`` from the pass that filters."""
    if n is not None and n < 0:
        raise ValueError("n must be >= 0")
    out = df.withColumn("_len", total_length(df, cols))
    cut = _cut(out, n, tie) if n else None
    if observed is not None:
        out = out.observe(observed, F.count(F.lit(1)).alias("n_input"))
    if cut:
        length, key = cut
        last = F.col("_len") == length
        out = out.filter((F.col("_len") < length) | (last if key is None else last & (F.col(tie) <= key)))
    return out.withColumnRenamed("_len", length_col) if length_col else out.drop("_len")


def shortest_n_per_group(df: DataFrame, n: int, by, cols=("solution",), tie: str = "sample_id",
                         length_col: str | None = None) -> DataFrame:
    """C1 within each group.  ``row_number <= n`` plans as a partial
    WindowGroupLimit before the shuffle, so a hot group ships at most n rows
    per map task."""
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.col("_len"), F.col(tie))
    out = (df.withColumn("_len", total_length(df, cols))
             .withColumn("_rn", F.row_number().over(w))
             .filter(F.col("_rn") <= n).drop("_rn"))
    if length_col:
        return out.withColumnRenamed("_len", length_col)
    return out.drop("_len")
