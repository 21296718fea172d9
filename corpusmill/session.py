"""Session construction and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no broadcast from static size estimates; AQE broadcasts a join side
    # only when its materialized (measured) size is under the limit
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # lists of about a row's size are gathered for so many keys at a time
    # before the aggregate falls back to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files are removed once their DataFrames are out of scope
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# only where driver and executors are one process
LOCAL_CONF = {
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def _default_driver_memory() -> str:
    """60% of the machine's memory, at most 8 GB, at least 1 GB (local runs;
    a cluster sets its own sizes)."""
    try:
        with open("/proc/meminfo") as fh:
            kb = int(next(line for line in fh if line.startswith("MemTotal")).split()[1])
        gb = max(1, min(8, int(kb / 1024 / 1024 * 0.6)))
    except Exception:  # noqa: BLE001
        gb = 4
    return f"{gb}g"


def get_session(master: str | None = None, app: str = "corpusmill",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    submitted = _submitted()
    where = master or submitted.get("spark.master", "local[*]")
    settings = dict(DEFAULT_CONF)
    if is_local(where):
        settings |= LOCAL_CONF
        settings["spark.driver.memory"] = os.environ.get("CORPUSMILL_DRIVER_MEMORY") or _default_driver_memory()
    settings = {k: v for k, v in settings.items() if not submitted.contains(k)}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if not submitted.contains("spark.app.name"):
        builder = builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _submitted() -> SparkConf:
    """What spark-submit passed on.  Only its JVM knows, so where there is one,
    or options for one, it is asked first."""
    if {"PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS"} & set(os.environ):
        SparkContext._ensure_initialized()
    return SparkConf()


def is_local(master: str) -> bool:
    """Driver and executors in one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


_OWN_ROOTS: dict[str, str] = {}  # application id -> folder made here


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (or the directory already set
    on the context); both must point at shared storage, and one of them must be
    set.  Only a local session without either gets a fresh local folder."""
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and sc is not None:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        current = sc.getCheckpointDir()
        if not root and current:
            # the context appends its own uuid folder; use its parent
            root = current.rsplit("/", 1)[0]
    if not root:
        if sc is None or not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _OWN_ROOTS.get(sc.applicationId)
        if root is None:
            root = _OWN_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="corpusmill-ckpt-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_SCOPES: list[str] = []  # of running jobs, innermost last


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder of this application under the shared root."""
    sc = _context(spark)
    app = sc.applicationId if sc is not None else "connect"
    return "/".join([checkpoint_root(spark), "corpusmill", app, *_SCOPES[-1:], f"{name}-{uuid.uuid4().hex[:12]}"])


@contextmanager
def scratch_scope(spark: SparkSession):
    """What is written to scratch inside is deleted at the end, whatever the
    outcome.  DataFrames that read such tables cannot be used after it."""
    path = scratch_path(spark, "job")
    _SCOPES.append("/".join([*_SCOPES[-1:], path.rsplit("/", 1)[1]]))
    try:
        yield
    finally:
        _SCOPES.pop()
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch, if there is one."""
    sc = _context(spark)
    if sc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query that is built and run inside are deleted when it
    ends, not when the driver happens to collect its garbage.  For queries that
    are run once: another run would make them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to scratch and read it back: the lineage is cut
    at files that survive a lost executor, and readers prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ScratchParts:
    """``df`` as Parquet in scratch, a folder for each of ``parts`` parts of its
    keys, for steps that join by ``key`` and would otherwise need disk for a
    shuffle of everything at once.  Rows of a key (and those without one) are in
    one part; ``part`` takes the same part of another table.  A part can be
    deleted when it is done."""

    def __init__(self, df: DataFrame, name: str, key: str, parts: int):
        self.spark, self.key, self.parts = df.sparkSession, key, parts
        self.path = scratch_path(self.spark, name)
        dealt = df.withColumn("_part", self._number(key))
        dealt.write.option("compression", "zstd").partitionBy("_part").parquet(self.path)
        self._table = self.spark.read.schema(dealt.schema).parquet(self.path)

    def _number(self, key: str) -> Column:
        # not the hash that shuffles deal by: a part would fill only some of their partitions
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def table(self) -> DataFrame:
        return self._table.drop("_part")

    def part(self, at: int, other: DataFrame | None = None) -> DataFrame:
        """Part ``at`` of this table, or of ``other``, whose key has the same type."""
        return self._table.filter(F.col("_part") == at).drop("_part") if other is None else other.filter(self._number(self.key) == at)

    def drop(self, at: int) -> None:
        drop_path(self.spark, f"{self.path}/_part={at}")
