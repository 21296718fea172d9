"""Dataset layout, names, paired sinks and run manifest."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import col_of
from corpusmill.sources.jsonl import write_jsonl


# Characters a name may not hold, and the prefixes of the two
# files of a run.
UNSAFE = '[<>:"|?*]'
ORIGINAL, REWRITTEN = "original", "code_switched"


def sanitize_name(c) -> Column:
    """A4: ``/`` and each of ``< > : " | ? *`` become ``_``; runs of ``_``
    collapse; outer ``_`` are trimmed."""
    x = F.regexp_replace(F.replace(col_of(c), F.lit("/"), F.lit("_")), UNSAFE, "_")
    return F.btrim(F.regexp_replace(x, "_+", "_"), F.lit("_"))


def sanitize_name_py(name: str) -> str:
    """A4 for driver-side names (paths), same rule."""
    return re.sub(r"_+", "_", re.sub(UNSAFE, "_", name.replace("/", "_"))).strip("_")


def write_dataset(df: DataFrame, root: str, name: str, subset_col: str | None = None,
                  split: str | Column = "train", fmt: str = "parquet") -> str:
    """Store a table as dataset ``name`` under ``root`` with ``subset`` and
    ``split`` as partition folders (subset from a column, or none)."""
    out = df.withColumn("split", split if isinstance(split, Column) else F.lit(split))
    cols = ["split"]
    if subset_col:
        out = out.withColumn("subset", F.col(subset_col))
        cols = ["subset", "split"]
    path = f"{root.rstrip('/')}/{sanitize_name_py(name)}"
    out.write.mode("overwrite").partitionBy(*cols).format(fmt).save(path)
    return path


def read_dataset(spark: SparkSession, root: str, name: str, subset: str | None = None,
                 split: str = "train", fmt: str = "parquet") -> DataFrame:
    """A3: (name, subset?, split) -> table.  The filters prune partition
    folders, so only the chosen split (and subset) is read.  A subset or split
    that the dataset does not have is an error; columns of the data that are
    called ``subset`` or ``split`` but are no folders stay."""
    path = f"{root.rstrip('/')}/{sanitize_name_py(name)}"
    df = spark.read.format(fmt).load(path)
    folders = _folder_levels(spark, path)
    for level, wanted in (("subset", subset), ("split", split)):
        if wanted is None:
            continue
        if level not in folders:
            raise ValueError(f"{path} has no {level} folders; {level} {wanted!r} cannot be read")
        df = df.filter(F.col(level) == wanted)
    if df.select(F.lit(1)).isEmpty() and not _has_folder(spark, path, folders, {"subset": subset, "split": split}):
        raise ValueError(f"{path} has no subset {subset!r} and split {split!r}")
    return df.drop(*folders)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` (one partition level)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return [s.getPath().getName() for s in found if s.isDirectory()]


def _folder_levels(spark: SparkSession, path: str) -> list[str]:
    """Which of ``subset`` and ``split`` are partition folders, outer first."""
    levels = []
    while len(levels) < 2:
        names = [n for n in _children(spark, path) if n.partition("=")[0] in ("subset", "split")]
        if not names:
            break
        levels.append(names[0].partition("=")[0])
        path = f"{path}/{names[0]}"
    return levels


def _has_folder(spark: SparkSession, path: str, levels: list[str], wanted: dict) -> bool:
    if not levels:
        return True
    names = [n for n in _children(spark, path) if n.startswith(levels[0] + "=")]
    if wanted[levels[0]] is not None:
        names = [n for n in names if unquote(n.partition("=")[2]) == wanted[levels[0]]]
    return any(_has_folder(spark, f"{path}/{n}", levels[1:], wanted) for n in names)


def output_filename(name: str, split: str, subset: str | None, n_rows: int, prefix: str = "") -> str:
    """``[prefix_]name_split[_subset]_rows.jsonl`` with the name sanitized."""
    base = f"{sanitize_name_py(name)}_{split}_{subset}_{n_rows}" if subset else f"{sanitize_name_py(name)}_{split}_{n_rows}"
    return f"{prefix}_{base}.jsonl" if prefix else f"{base}.jsonl"


def write_original(selected: DataFrame, out_dir: str, name: str, split: str, subset: str | None,
                   n_rows: int, compression: str | None = None) -> str:
    """A5, first half: the selected input rows, written before any call."""
    path = f"{out_dir.rstrip('/')}/{output_filename(name, split, subset, n_rows, ORIGINAL)}"
    return write_jsonl(selected, path, compression)


def write_rewritten(rewritten: DataFrame | Iterable[DataFrame], out_dir: str, name: str, split: str, subset: str | None,
                    n_rows: int, compression: str | None = None) -> str:
    """A5, second half: the rewritten rows, written after the rewrite, whole or
    part after part."""
    path = f"{out_dir.rstrip('/')}/{output_filename(name, split, subset, n_rows, REWRITTEN)}"
    return write_jsonl(rewritten, path, compression)


def outcome_counts() -> list[Column]:
    """The counts of A6 as aggregates, for ``agg`` or ``observe``."""
    return [F.count(F.lit(1)).cast("bigint").alias("n_selected"),
            *[F.count_if(F.col("outcome") == o).cast("bigint").alias(f"n_{o}")
              for o in ("rewritten", "kept_long", "failed", "blank")]]


def observed_manifest(spark: SparkSession, outcomes: Observation, n_input: int | None = None, **settings) -> DataFrame:
    """A6 without a pass of its own: the counts (``outcome_counts``) come from
    the write they describe, where ``outcomes`` observed them.  Observe the
    DataFrame that is written itself: tasks of its last stage count once, also
    when an executor is lost.  A write of no rows may report nothing; its
    counts are 0."""
    names = ["n_selected", "n_rewritten", "n_kept_long", "n_failed", "n_blank"]
    counts = spark.range(1).select(*[F.lit(outcomes.get.get(n) or 0).cast("bigint").alias(n) for n in names])
    return _with_settings(counts, n_input, settings)


def run_manifest(verdicts: DataFrame, n_input: int | Column | None = None, **settings) -> DataFrame:
    """One-row run record: row counts per outcome plus the settings
    (paths, model, columns ...) as literal columns."""
    return _with_settings(verdicts.agg(*outcome_counts()), n_input, settings)


def _with_settings(counts: DataFrame, n_input: int | Column | None, settings: dict) -> DataFrame:
    extra = []
    if n_input is not None:
        extra.append((n_input if isinstance(n_input, Column) else F.lit(n_input)).cast("bigint").alias("n_input"))
    for k, v in sorted(settings.items()):
        extra.append(F.lit(None if v is None else str(v)).cast("string").alias(k))
    return counts.select("*", *extra, F.when(F.col("n_selected") > 0, "completed").otherwise("empty").alias("status"))
