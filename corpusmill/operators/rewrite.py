"""Column rewrite through a transformer and its audit.

The transformer is any callable ``fn(request) -> str | None`` (raise on a
failed call).  ``request`` is a dict with ``sample_id``, ``attempt``, ``kind``
(primary / focus), ``text`` (the stripped solution) and ``messages`` (the
prompt).  Calls run inside ``mapInArrow`` (``mapInPandas`` with a log that is
committed) with a bounded thread pool per task; every call is logged as a row (sample_id, attempt, kind, status, text)
and the accept rule is then evaluated relationally (``choose_candidate``).
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import col_of, is_blank, split_sentences, strip
from corpusmill.operators.lexicon import lexicon_rewrite_table, rewrite_text
from corpusmill.session import scratch_scope, scratch_table, shuffles_dropped

# Our own prompt wording; callers normally pass their own.
DEFAULT_SYSTEM_PROMPT = (
    "Rewrite English step-by-step reasoning into a shorter mixed Korean-English form. "
    "Keep every sentence, in order, one output sentence per input sentence. "
    "Never make a sentence longer. Leave all mathematics, symbols and the final answer unchanged.")
DEFAULT_TEMPLATE = (
    "Rewrite the reasoning below sentence by sentence. Output the same number of sentences, "
    "each no longer than its source.\n\nReasoning:\n{text}")
DEFAULT_FOCUS_TEMPLATE = (
    "The last rewrite was too long. The reasoning has {n_sentences} sentences and {budget} characters; "
    "return exactly {n_sentences} sentences and at most {budget} characters in total.\n\nReasoning:\n{text}")

LOG_SCHEMA = "sample_id bigint, attempt int, kind string, status string, text string"
LOG_ARROW = pa.schema({"sample_id": pa.int64(), "attempt": pa.int32(), "kind": pa.string(), "status": pa.string(), "text": pa.string()})
LOG_COLUMNS = LOG_ARROW.names


# ---- D1, D2: requests -------------------------------------------------------

def _fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def build_request(df: DataFrame, system: str = DEFAULT_SYSTEM_PROMPT, template: str = DEFAULT_TEMPLATE,
                  col: str = "solution") -> DataFrame:
    """Two chat messages, the system prompt and the template with the
    stripped solution in place of ``{text}``."""
    user = _fill(template, {"text": strip(col)})
    return df.withColumn("messages", F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system.strip()).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))


def build_focus_request(df: DataFrame, system: str = DEFAULT_SYSTEM_PROMPT,
                        template: str = DEFAULT_FOCUS_TEMPLATE, col: str = "solution") -> DataFrame:
    """The second prompt, with the sentence count and the character
    budget (length of the stripped original) filled in."""
    s = strip(col)
    user = _fill(template, {"n_sentences": F.size(split_sentences(s)), "budget": F.length(s), "text": s})
    return df.withColumn("focus_messages", F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system.strip()).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content"))))


def load_system_prompt(path: str | None) -> str:
    """System prompt from a file (stripped); our default when it is missing."""
    if path:
        try:
            with open(path, encoding="utf-8") as fh:
                return fh.read().strip()
        except FileNotFoundError:
            pass
    return DEFAULT_SYSTEM_PROMPT


# ---- D3: calls ------------------------------------------------------------

def _fill_py(template: str, **values) -> str:
    out = template
    for k, v in values.items():
        out = out.replace("{" + k + "}", str(v))
    return out


def _sentences_py(text: str) -> int:
    from corpusmill.functions.text import WS
    ws = "[" + re.escape(WS) + "]"
    return len([p for p in (x.strip() for x in re.split("[.!?]+" + ws + "+", text.strip())) if p])


def call_sequence(sample_id: int, solution: str, transformer, max_retries: int, retry_delay: float,
                  system: str, template: str, focus_template: str, sleep=time.sleep) -> list[tuple]:
    """All calls made for one row, as log tuples.

    Up to ``max_retries`` attempts; an empty answer moves on at once; an
    exception waits ``retry_delay * 2**attempt`` unless it was the last
    attempt; a too-long answer on attempt 0 triggers one focus call in the
    same attempt; a too-long answer on a later attempt is final."""
    text = solution.strip()
    budget = len(text)
    log: list[tuple] = []
    sysmsg = {"role": "system", "content": system}
    for attempt in range(max_retries):
        kind = "primary"
        try:
            req = {"sample_id": sample_id, "attempt": attempt, "kind": kind, "text": text,
                   "messages": [sysmsg, {"role": "user", "content": _fill_py(template, text=text)}]}
            content = transformer(req)
            log.append((sample_id, attempt, kind, "ok", content))
            if not content or not content.strip():
                continue
            if len(content.strip()) <= budget or attempt > 0:
                return log
            kind = "focus"
            user = _fill_py(focus_template, n_sentences=_sentences_py(text), budget=budget, text=text)
            req = {"sample_id": sample_id, "attempt": attempt, "kind": kind, "text": text,
                   "messages": [sysmsg, {"role": "user", "content": user}]}
            focus = transformer(req)
            log.append((sample_id, attempt, kind, "ok", focus))
            if focus:
                return log
        except Exception:  # noqa: BLE001 - a failed call is data here
            log.append((sample_id, attempt, kind, "error", None))
            if attempt < max_retries - 1:
                sleep(retry_delay * (2 ** attempt))
    return log


def _caller(transformer, max_retries: int = 3, max_concurrent: int = 5, retry_delay: float = 1.0,
            system: str = DEFAULT_SYSTEM_PROMPT, template: str = DEFAULT_TEMPLATE,
            focus_template: str = DEFAULT_FOCUS_TEMPLATE):
    """``(pool, log)`` of a task: a context with ``max_concurrent`` threads and
    the function that makes the calls of a frame (key, text) in it."""
    def calls(k, s):
        return call_sequence(int(k), s, transformer, max_retries, retry_delay, system, template, focus_template)

    def log(pool, pdf):
        done = (pool.map if pool else map)(calls, pdf.iloc[:, 0], pdf.iloc[:, 1])
        return pd.DataFrame([row for rows in done for row in rows], columns=LOG_COLUMNS).astype({"sample_id": "int64", "attempt": "int32"})

    return (lambda: ThreadPoolExecutor(max_workers=max_concurrent)) if max_concurrent > 1 else nullcontext, log


def rewrite(df: DataFrame, transformer, key: str = "sample_id", col: str = "solution", **kwargs) -> DataFrame:
    """D3: the attempt log.  Rows are processed by Spark tasks, each with a
    pool of ``max_concurrent`` threads (total concurrency = running tasks x
    max_concurrent); the other options are those of ``_caller``.  Spark may
    evaluate a plan more than once; ``run_rewrite`` calls once and keeps the log."""
    open_pool, log = _caller(transformer, **kwargs)

    def run(batches):
        with open_pool() as pool:
            for batch in batches:
                for piece in _pieces(batch):
                    yield pa.RecordBatch.from_pandas(log(pool, piece.to_pandas()), LOG_ARROW, preserve_index=False)

    return df.select(F.col(key).cast("bigint").alias(key), col).mapInArrow(run, LOG_SCHEMA)


PIECE_BYTES = 4 << 20  # texts that a task of ``rewrite`` holds as Python objects at a time, one text at least


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch (key, text) of at most PIECE_BYTES of text, whatever the batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


TASK_ROWS = 500  # rows per task, up to MAX_TASKS tasks; beyond that tasks are longer
MAX_TASKS = 10_000
COMMIT_ROWS = 2000  # at most so many rows per committed file of the log


def read_log(spark, log_path: str) -> DataFrame | None:
    """The call log, or None before its first commit."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(log_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _commits(log_uri: str, open_pool, log, commit_rows: int):
    """Make the calls of a task piece by piece.  A piece is one file of the log,
    named by its keys, written under a temporary name (which readers skip) and
    renamed; one that an earlier run of the task has left is not called again."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(log_uri)
        with open_pool() as pool:
            for pdf in batches:
                for at in range(0, len(pdf), commit_rows):
                    piece = pdf.iloc[at:at + commit_rows]
                    keys = hashlib.sha256(",".join(map(str, piece.iloc[:, 0])).encode()).hexdigest()
                    name = f"{root}/calls-{keys}.parquet"
                    if fs.get_file_info(name).type == pafs.FileType.NotFound:
                        made = pa.Table.from_pandas(log(pool, piece), LOG_ARROW, preserve_index=False)
                        temporary = f"{root}/_{keys}-{uuid.uuid4().hex}"
                        pq.write_table(made, temporary, filesystem=fs, compression="zstd")
                        fs.move(temporary, name)
                    yield pd.DataFrame({"n": [len(piece)]})

    return run


def run_rewrite(df: DataFrame, transformer, log_path: str, task_rows: int = TASK_ROWS, commit_rows: int = COMMIT_ROWS,
                key: str = "sample_id", col: str = "solution", stored: bool = False, **kwargs) -> DataFrame:
    """D3 with a persisted log and restart.

    Rows already in the log are skipped.  The others are written once (not if
    ``stored``: ``df`` reads files that stay as they are meanwhile), dealt by
    key to tasks of about ``task_rows`` and called in one job by the whole
    cluster; what was written and shuffled for that is deleted after it.  Every
    task commits its pieces of at most ``commit_rows`` to the log by itself, so a
    failure, of a task or of the job, loses the calls of the pieces at work and
    nothing else.  The log folder must be on storage that ``pyarrow.fs`` opens."""
    spark = df.sparkSession
    todo = df.select(F.col(key).cast("bigint").alias(key), col)
    log = read_log(spark, log_path)
    if log is not None:
        todo = todo.join(log.select(F.col("sample_id").alias(key)).distinct(), key, "left_anti")
    with scratch_scope(spark), shuffles_dropped(spark):
        todo = todo if stored else scratch_table(todo, "calls-to-make")
        # an empty part makes the folder and tells its address in full
        spark.createDataFrame([], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)
        log_uri = spark.read.schema(LOG_SCHEMA).parquet(log_path).inputFiles()[0].rpartition("/")[0]
        log_uri = re.sub("^s3[an]:", "s3:", log_uri)
        tasks = min(MAX_TASKS, max(1, -(-todo.count() // task_rows)))
        # the same rows in the same order whenever a task is run again
        dealt = todo.repartition(tasks, key).sortWithinPartitions(key, col)
        dealt.mapInPandas(_commits(log_uri, *_caller(transformer, **kwargs), commit_rows), "n bigint").agg(F.sum("n")).collect()
    return read_log(spark, log_path)


def lexicon_attempts(df: DataFrame, lexicon: DataFrame, key: str = "sample_id", col: str = "solution") -> DataFrame:
    """The call log of the lexicon rewrite (D9) over a table: one ``ok`` call
    per row, made by joins, whatever the size of the lexicon."""
    done = lexicon_rewrite_table(df.select(key, strip(col).alias("_text")), "_text", key, lexicon)
    return done.select(F.col(key).cast("bigint").alias("sample_id"), F.lit(0).alias("attempt"), F.lit("primary").alias("kind"),
                       F.lit("ok").alias("status"), F.col("rewritten").alias("text"))


class LexiconTransformer:
    """Deterministic transformer: the lexicon rewrite of the request text.
    Local and CPU-bound, so run it with ``max_concurrent=1``."""

    def __init__(self, mapping: dict[str, str]):
        self.mapping = dict(mapping)

    def __call__(self, request) -> str:
        return rewrite_text(request["text"], self.mapping)


# ---- D4-D6: accept rule ------------------------------------------------------

OUTCOMES = ("rewritten", "kept_long", "failed", "blank")


def call_verdict(attempt: Column, kind: Column, status: Column, text: Column, budget: Column):
    """Per logged call: (outcome if terminal else null, chosen text)."""
    st = strip(text)
    nonblank = F.coalesce(F.length(st) > 0, F.lit(False))
    nonempty = F.coalesce(F.length(text) > 0, F.lit(False))
    fits = F.length(st) <= budget
    primary, focus = kind == "primary", kind == "focus"
    outcome = (F.when(status != "ok", F.lit(None))
               .when(primary & nonblank & fits, F.lit("rewritten"))
               .when(primary & nonblank & (attempt >= 1), F.lit("kept_long"))
               .when(focus & nonempty & fits & (F.length(st) == 0), F.lit("failed"))
               .when(focus & nonempty & fits, F.lit("rewritten"))
               .when(focus & nonempty, F.lit("kept_long")))
    return outcome.cast("string"), st


def choose_candidate(samples: DataFrame, attempts: DataFrame, max_retries: int = 3,
                     key: str = "sample_id", col: str = "solution", with_original: bool = True) -> DataFrame:
    """One row per rewritable sample: (key, outcome, chosen, n_calls,
    orig_len, the length of the stripped original).

    The first terminal call in (attempt, primary before focus) order decides;
    none within ``max_retries`` attempts -> failed.  kept_long carries the
    stripped original.  The call log is joined with the character budget
    only (no text), reduced to one row per sample with a partial aggregate,
    and the original text is attached in the single final join.  With
    ``with_original=False`` that join carries keys only and kept_long rows
    have no ``chosen`` (``apply_verdict`` takes the text from the sample)."""
    todo = samples.filter(~is_blank(col))
    budget = todo.select(key, F.length(strip(col)).alias("_budget"))
    calls = attempts.filter(F.col("attempt") < max_retries).join(budget, key)
    outcome, st = call_verdict(F.col("attempt"), F.col("kind"), F.col("status"), F.col("text"), F.col("_budget"))
    ranked = calls.select(
        key, (F.col("attempt") * 2 + F.when(F.col("kind") == "focus", 1).otherwise(0)).alias("_ord"),
        outcome.alias("_outcome"), F.when(outcome == "rewritten", st).alias("_text"))
    per = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.min(F.when(F.col("_outcome").isNotNull(), F.struct("_ord", "_outcome", "_text"))).alias("_first"))
    orig = strip(col) if with_original else F.lit(None).cast("string")
    out = todo.select(key, orig.alias("_orig"), F.length(strip(col)).cast("bigint").alias("orig_len")).join(per, key, "left")
    outcome = F.coalesce(F.col("_first._outcome"), F.lit("failed"))
    return out.select(
        key, outcome.alias("outcome"),
        F.when(outcome == "rewritten", F.col("_first._text"))
         .when(outcome == "kept_long", F.col("_orig")).alias("chosen"),
        F.coalesce(F.col("n_calls"), F.lit(0)).cast("bigint").alias("n_calls"), "orig_len")


def apply_verdict(samples: DataFrame, chosen: DataFrame, key: str = "sample_id",
                  col: str = "solution") -> DataFrame:
    """Rewritten / kept_long rows keep exactly question, solution (the
    chosen text), answer (missing -> ''), extras null; failed rows and blank
    solutions are the original row.  Adds ``outcome``."""
    v = chosen.select(key, "outcome", "chosen")
    joined = samples.join(v, key, "left")
    outcome = F.coalesce(F.col("outcome"), F.lit("blank"))
    changed = outcome.isin("rewritten", "kept_long")
    cols = []
    for c in samples.columns:
        if c == key:
            cols.append(F.col(c))
        elif c == col:
            # kept_long keeps the stripped original, taken from the sample row
            kept = F.when(outcome == "kept_long", strip(F.col(c))).otherwise(F.col("chosen"))
            cols.append(F.when(changed, kept).otherwise(F.col(c)).alias(c))
        elif c in ("question", "answer"):
            cols.append(F.when(changed, F.coalesce(F.col(c), F.lit(""))).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.when(~changed, F.col(c)).alias(c))
    return joined.select(*cols, outcome.alias("outcome"))


def gain_of_lengths(orig_len, new_len) -> Column:
    """D6 from lengths that are known already (``choose_candidate``)."""
    o, n = col_of(orig_len).cast("double"), col_of(new_len).cast("double")
    return F.try_divide(o - n, o) * 100.0


def length_gain(orig, new) -> Column:
    """(orig_len - new_len) / orig_len * 100 as double."""
    return gain_of_lengths(F.length(col_of(orig)), F.length(col_of(new)))


# ---- D7, D8, D11, D12: pair checks --------------------------------------------

def sentence_alignment(df: DataFrame, orig: str = "original", new: str = "rewrite") -> DataFrame:
    """D8 roll-up: sentence counts, positions where the rewrite is longer,
    and ``aligned`` (same count, none longer).  Both sentence arrays are
    projected first so the lambda reads columns, not re-evaluated splits."""
    out = df.withColumn("_a", split_sentences(orig)).withColumn("_b", split_sentences(new))
    longer = F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: F.when(F.length(y) > F.length(x), 1).otherwise(0)),
        F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn("n_orig", F.size("_a").cast("bigint")).withColumn("n_new", F.size("_b").cast("bigint")) \
        .withColumn("n_longer", longer.cast("bigint")).drop("_a", "_b")
    return out.withColumn("aligned", (F.col("n_orig") == F.col("n_new")) & (F.col("n_longer") == 0))


def sentence_alignment_rows(df: DataFrame, key: str, orig: str = "original", new: str = "rewrite") -> DataFrame:
    """D8 detail: one row per position (either side), both lengths, verdict.
    Every text is split once, before its rows are made, and only the lengths of
    its sentences go on to them."""
    def lengths(c):
        return F.coalesce(F.transform(split_sentences(c), F.length), F.array().cast("array<int>"))

    once = df.select(key, lengths(orig).alias("orig_len"), lengths(new).alias("new_len"))
    rows = once.select(key, F.posexplode(F.arrays_zip("orig_len", "new_len")).alias("pos", "_l")).select(key, "pos", "_l.*")
    return rows.withColumn("ok", F.coalesce(F.col("new_len") <= F.col("orig_len"), F.lit(False)))


# Notation that must survive a rewrite unchanged.
MATH_SPAN = r"\$[^$]*\$"
OPERATORS = r"[-+*/=<>^×÷≤≥≠±∫∑]"
BOXED = r"\\boxed\{[^{}]*\}"
FINAL_ANSWER = r"\*\*Final Answer\*\*[\x{9}-\x{D}\x{20}]*\\boxed\{([^{}]*)\}"


def _bag(c, pattern: str) -> Column:
    return F.sort_array(F.regexp_extract_all(col_of(c), F.lit(pattern), F.lit(0)))


def notation_preserved(df: DataFrame, orig: str = "original", new: str = "rewrite") -> DataFrame:
    """$...$ spans, operator symbols and \\boxed{...} as equal multisets."""
    out = df.withColumn("math_ok", _bag(orig, MATH_SPAN) == _bag(new, MATH_SPAN)) \
            .withColumn("ops_ok", _bag(orig, OPERATORS) == _bag(new, OPERATORS)) \
            .withColumn("boxed_ok", _bag(orig, BOXED) == _bag(new, BOXED))
    return out.withColumn("preserved", F.col("math_ok") & F.col("ops_ok") & F.col("boxed_ok"))


def final_answer_kept(df: DataFrame, orig: str = "original", new: str = "rewrite") -> DataFrame:
    """A final-answer line with \\boxed{...} in the source must be in the
    rewrite with the same content."""
    has = F.regexp_like(F.col(orig), F.lit(FINAL_ANSWER))
    same = F.regexp_like(F.col(new), F.lit(FINAL_ANSWER)) & \
        (F.regexp_extract(F.col(orig), FINAL_ANSWER, 1) == F.regexp_extract(F.col(new), FINAL_ANSWER, 1))
    return df.withColumn("has_final", has).withColumn("kept", ~has | same)


# ---- D13, D14: report and pairing ---------------------------------------------

def rewrite_report(verdicts: DataFrame) -> DataFrame:
    """Rows, calls and mean gain per outcome plus a total row
    (``outcome`` = 'total').  ``verdicts`` has outcome, n_calls, gain."""
    agg = verdicts.rollup("outcome").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("n_samples"),
        F.coalesce(F.sum("n_calls"), F.lit(0)).cast("bigint").alias("n_calls"),
        F.avg("gain").alias("mean_gain"))
    return agg.select(F.when(F.col("_g") > 0, F.lit("total")).otherwise(F.col("outcome")).alias("outcome"),
                      F.col("n_samples").cast("bigint").alias("n_samples"), "n_calls",
                      F.round("mean_gain", 4).alias("mean_gain"))


def pair_corpora(original: DataFrame, rewritten: DataFrame, key: str = "sample_id",
                 col: str = "solution") -> DataFrame:
    """Originals and rewrites brought together by key (never by
    position); a full outer join keeps losses on either side."""
    o = original.select(key, F.col(col).alias("original_solution"))
    r = rewritten.select(key, F.col(col).alias("rewritten_solution"), F.lit(True).alias("_r"))
    o = o.withColumn("_o", F.lit(True))
    j = o.join(r, key, "full_outer")
    status = (F.when(F.col("_o") & F.col("_r"), "both").when(F.col("_o"), "original_only")
              .otherwise("rewritten_only"))
    return j.select(key, "original_solution", "rewritten_solution", status.alias("status"),
                    F.coalesce(~F.col("original_solution").eqNullSafe(F.col("rewritten_solution")),
                               F.lit(False)).alias("changed"))
