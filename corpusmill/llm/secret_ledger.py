"""Secret scan with an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its bytes.  The
ledger, a Parquet table that only grows, holds for each scanned blob the rule
versions applied and the findings.  A run scans each distinct blob once, and
only with the rule versions the ledger does not have for it; findings are then
joined back to every row (path, commit, document) that holds the blob.

Defined results: null text is the empty blob; repeated rows share one scan and
each get its findings; an empty table adds nothing to the ledger; columns
other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table, text_batches


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters
    or more.  A changed rule gets a new version and is scanned anew."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(self.pattern, text, re.ASCII) if len(m[self.group]) >= self.least]


# unseen blobs are broadcast to the texts up to this measured size
UNSEEN_BYTES = 32 << 20

BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # leftmost runs of 24 or more: whole runs
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    # starts where a run of its characters starts, so no run is read more than a few times
    Rule("signed_token", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

FINDINGS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.ArrayType(T.StringType())),
                       T.StructField("findings", FINDINGS)])


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None before its first entry."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _scan(todo: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    by_name = {r.name: r for r in rules}
    item = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": by_name[n].kind, "version": by_name[n].version, "start": a, "end": b}
                      for n in names for a, b in by_name[n].spans(text)]
                     for text, names in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, pa.list_(item))],
                                             ["blob", "rules", "findings"])

    return text_batches(todo.select("blob", "rules", "text")).mapInArrow(run, LEDGER)


def scan_versions(versions: DataFrame, ledger: str, key: str = "doc_id", text: str = "text",
                  rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger at ``ledger`` up to date and return ``(key, blob,
    findings)`` of every row of ``versions``; findings are ordered by start,
    then as ``rules``."""
    spark = versions.sparkSession
    names = [r.name for r in rules]
    current = F.array(*[F.lit(n) for n in names])
    body = F.coalesce(F.col(text), F.lit(""))
    texts = versions.select(blob_of(F.col(text)).alias("blob"), body.alias("text"))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = texts.dropDuplicates(["blob"]).withColumn("rules", current)
    else:
        # digests and rule versions first; a text moves only if one is unseen
        seen = known.select("blob", F.explode("rules").alias("rule")).distinct().groupBy("blob").agg(F.collect_list("rule").alias("seen"))
        unseen = texts.select("blob").distinct().join(seen, "blob", "left").select(
            "blob", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
        unseen = spill_table(unseen, "unseen-blobs", few=True)
        small = unseen.count() * (64 + 32 * len(names)) <= UNSEEN_BYTES
        todo = texts.join(F.broadcast(unseen) if small else unseen, "blob").dropDuplicates(["blob"])
    _scan(todo, rules).write.mode("append").parquet(ledger)

    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    wanted = F.filter("findings", lambda f: F.concat(f["kind"], F.lit("@"), f["version"].cast("string")).isin(*names))
    # distinct: runs at the same time may have entered a blob more than once
    found = read_ledger(spark, ledger).select("blob", F.explode(wanted).alias("f")).select("blob", "f.start", "f.kind", "f.end").distinct()
    ranked = F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end")))
    # written, so that the join is one of two exchanges and AQE can split a hot blob
    found = spill_table(found.groupBy("blob").agg(ranked.alias("findings")), "secret-findings", few=True)
    rows = versions.select(F.col(key).alias("key"), blob_of(F.col(text)).alias("blob"))
    return (rows.join(found, "blob", "left")
            .select(F.col("key").alias(key), "blob", F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)).alias("findings")))
