"""Registered source and sink queries (A1-A6).  Files go to fresh folders
under the shared checkpoint root (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators.rewrite import LexiconTransformer, apply_verdict, choose_candidate, run_rewrite
from corpusmill.operators.validate import rewritable
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import table, view, with_views
from corpusmill.plans.registry import query
from corpusmill.plans.rewrite_queries import APPLIED, REWRITABLE, lexicon_mapping, rewrite_ctes
from corpusmill.session import ScratchParts, path_bytes, scratch_path, scratch_scope, shuffles_dropped
from corpusmill.sources.datasets import (read_dataset, run_manifest, sanitize_name, write_dataset,
                                         write_original, write_rewritten)
from corpusmill.sources.jsonl import read_jsonl, write_jsonl

SAMPLES_SCHEMA = ("sample_id bigint, question string, solution string, answer string, text string, "
                  "input string, output string, lang string, source string")
SAMPLE_COLS = "sample_id, question, solution, answer, text, input, output, lang, source"


@query("read_jsonl", with_views(["samples"], f"SELECT {SAMPLE_COLS} FROM samples"))
def q_read_jsonl(spark, sf_dir):
    path = write_jsonl(view(spark, sf_dir, "samples"), scratch_path(spark, "jsonl"))
    return read_jsonl(spark, path, SAMPLES_SCHEMA, mode="strict")


@query("write_jsonl", with_views(["samples"], "SELECT sample_id, CAST(9 AS BIGINT) AS n_keys, solution FROM samples"))
def q_write_jsonl(spark, sf_dir):
    path = write_jsonl(view(spark, sf_dir, "samples"), scratch_path(spark, "jsonl"))
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.sample_id").cast("bigint").alias("sample_id"),
                        F.size(F.json_object_keys("value")).cast("bigint").alias("n_keys"),
                        F.get_json_object("value", "$.solution").alias("solution"))


@query("read_dataset", """
SELECT 'all' AS asked, doc_id, text, lang, source, n_chars FROM documents
UNION ALL SELECT 'de', doc_id, text, lang, source, n_chars FROM documents WHERE lang = 'de'""")
def q_read_dataset(spark, sf_dir):
    root = scratch_path(spark, "datasets")
    write_dataset(table(spark, sf_dir, "documents"), root, "corpus/documents", subset_col="lang")
    whole = read_dataset(spark, root, "corpus/documents", subset=None, split="train").withColumn("asked", F.lit("all"))
    return whole.unionByName(read_dataset(spark, root, "corpus/documents", subset="de", split="train").withColumn("asked", F.lit("de")))


@query("sanitize_name", """
SELECT page_id, trim(regexp_replace(regexp_replace(replace(url, '/', '_'), '[<>:"|?*]', '_', 'g'), '_+', '_', 'g'), '_') AS name
FROM pages""")
def q_sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sanitize_name("url").alias("name"))


PART_BYTES = 64 << 20  # of the packed selection for each part of the keys, up to MAX_PARTS parts
MAX_PARTS = 4


def _rewritten_parts(selected: ScratchParts, log):
    """The rewritten rows of one part after the other; the selection of a part
    is deleted when the next one is asked for."""
    for at in range(selected.parts):
        some = selected.part(at)
        yield apply_verdict(some, choose_candidate(some, selected.part(at, log), with_original=False))
        selected.drop(at)


_A5 = dict(REWRITABLE)
_A5.update(rewrite_ctes("todo", "sample_id", "sol", "todo_rw"))


@query("paired_sinks", with_views(["samples", "lexicon"], f"""
SELECT 'original' AS file, sample_id, question, solution, answer FROM samples
UNION ALL
SELECT 'code_switched', s.sample_id,
  CASE WHEN r.sample_id IS NULL THEN s.question ELSE coalesce(s.question, '') END,
  CASE WHEN r.sample_id IS NULL THEN s.solution ELSE {Q.strip('r.rewritten')} END,
  CASE WHEN r.sample_id IS NULL THEN s.answer ELSE coalesce(s.answer, '') END
FROM samples s LEFT JOIN todo_rw r USING (sample_id)""", _A5))
def q_paired_sinks(spark, sf_dir):
    """Both files are packed, and the rewrite meets the selection a part of the
    keys at a time: plain lines, or one shuffle of all texts, take more disk than
    four times the table."""
    out_dir = scratch_path(spark, "paired")
    source = view(spark, sf_dir, "samples")
    n_rows = source.select("sample_id").count()
    original = write_original(source, out_dir, "documents", "train", None, n_rows, compression="gzip")
    parts = min(MAX_PARTS, 1 + path_bytes(spark, original) // PART_BYTES)
    with scratch_scope(spark), shuffles_dropped(spark):
        # the selection is made once, and the file is parsed once for the steps that take it
        selected = ScratchParts(read_jsonl(spark, original, SAMPLES_SCHEMA), "selected", "sample_id", parts)
        log = run_rewrite(selected.table().filter(rewritable()), LexiconTransformer(lexicon_mapping(spark, sf_dir)),
                          f"{out_dir}/attempt_log", stored=True, retry_delay=0.0, max_concurrent=1)
        rewritten_path = write_rewritten(_rewritten_parts(selected, log), out_dir, "documents", "train", None, n_rows, compression="gzip")
    cols = ["sample_id", "question", "solution", "answer"]
    a = read_jsonl(spark, original, SAMPLES_SCHEMA).select(F.lit("original").alias("file"), *cols)
    b = read_jsonl(spark, rewritten_path, SAMPLES_SCHEMA).select(F.lit("code_switched").alias("file"), *cols)
    return a.unionByName(b)


@query("run_manifest", with_views(["samples", "candidates"], """
SELECT CAST(count(*) AS BIGINT) AS n_selected,
  CAST(count(*) FILTER (WHERE outcome = 'rewritten') AS BIGINT) AS n_rewritten,
  CAST(count(*) FILTER (WHERE outcome = 'kept_long') AS BIGINT) AS n_kept_long,
  CAST(count(*) FILTER (WHERE outcome = 'failed') AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (WHERE outcome = 'blank') AS BIGINT) AS n_blank,
  CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_input,
  'solution' AS columns, '3' AS max_retries, 'scripted' AS model,
  CASE WHEN count(*) > 0 THEN 'completed' ELSE 'empty' END AS status
FROM applied""", APPLIED))
def q_run_manifest(spark, sf_dir):
    samples = view(spark, sf_dir, "samples")
    applied = apply_verdict(samples, choose_candidate(samples, view(spark, sf_dir, "candidates"), with_original=False))
    n_input = table(spark, sf_dir, "documents").count()
    return run_manifest(applied, n_input=n_input, model="scripted", max_retries=3, columns="solution")
