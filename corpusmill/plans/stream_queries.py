"""Registered streaming queries I1-I4: the input view is written as JSONL
into a fresh folder under the checkpoint root in three deliveries of as many
files as the view has tasks; the stream starts again after each, takes it as
one micro-batch (``availableNow``) and goes on from its checkpoint; the sink is
read back.  Each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.plans.chat_queries import SEGMENTS_SQL
from corpusmill.plans.fixtures import view, with_views
from corpusmill.plans.prepare_queries import FORMATTED
from corpusmill.plans.registry import query
from corpusmill.operators.think import MAX_THINK_LENGTH
from corpusmill.plans.sqltext import STATS_AGGS, count_lit, span_lens, spans, think_features
from corpusmill.session import scratch_path
from corpusmill.streaming.jobs import chunk_stream, prepare_stream, read_stats, session_stream, stats_stream

SAMPLES_SCHEMA = ("sample_id long, question string, solution string, answer string, text string, "
                  "input string, output string, lang string, source string")
FIELDS_SCHEMA = "doc_id long, formatted_response string, text string, solution string, content string"


def _folders(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def _feed(df, path, part, stream):
    """Three deliveries in order of ``part`` (0, 1, 2), every task of ``df`` with
    a file of its own; ``stream()`` takes each before the next is written."""
    for i in range(3):
        df.filter(part == i).write.mode("append").option("ignoreNullFields", "false").json(path)
        stream()


_GATED = dict(FORMATTED)
_GATED["gated"] = f"""
SELECT *, CASE WHEN kind = 'qa' THEN array_to_string(list_filter([
    CASE WHEN o = 0 AND c = 0 THEN 'no_tags' END,
    CASE WHEN o <> c THEN 'unbalanced' END,
    CASE WHEN o = c AND len(sp) < o THEN 'misordered' END,
    CASE WHEN len(list_filter(lens, lambda x: x > {MAX_THINK_LENGTH})) > 0 THEN 'too_long' END],
  lambda r: r IS NOT NULL), ',') END AS reasons
FROM (SELECT *, {count_lit('text', '<think>')} AS o, {count_lit('text', '</think>')} AS c,
             {spans('text')} AS sp, {span_lens('text')} AS lens FROM formatted)"""


@query("stream_prepare", with_views(["samples"], """
SELECT sample_id, kind, user_content, assistant_content, text, input, output, reasons FROM gated""", _GATED))
def q_stream_prepare(spark, sf_dir):
    src, out, ckpt = _folders(spark, "stream-prepare")
    _feed(view(spark, sf_dir, "samples"), src, F.col("sample_id") % 3,
          lambda: prepare_stream(spark, src, out, ckpt, SAMPLES_SCHEMA))
    df = spark.read.parquet(out)
    return df.select("sample_id", "kind", F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"), "text", "input", "output",
                     F.array_join("reasons", ",").alias("reasons"))


@query("chunk_assembly", with_views(["turns"], """
SELECT conv_id, turn, string_agg(coalesce(text, ''), '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM turns"""))
def q_chunk_assembly(spark, sf_dir):
    src, out, ckpt = _folders(spark, "stream-chunks")
    _feed(view(spark, sf_dir, "turns"), src, (F.col("turn") * 2 + F.col("conv_id")) % 3,  # chunks come out of order
          lambda: chunk_stream(spark, src, out, ckpt))
    return spark.read.parquet(out)


@query("stream_sessions", with_views(["inputs"], SEGMENTS_SQL))
def q_stream_sessions(spark, sf_dir):
    src, out, ckpt = _folders(spark, "stream-sessions")
    inputs = view(spark, sf_dir, "inputs")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = inputs.agg(F.min(at), F.max(at)).first()
    step = (last - first) // 3 + 1 if first is not None else 1
    _feed(inputs, src, F.floor((at - F.lit(first or 0)) / step), lambda: session_stream(spark, src, out, ckpt))
    return spark.read.parquet(out)


@query("stream_stats", with_views(["fields"], f"""
SELECT {STATS_AGGS}
FROM (SELECT {think_features('t')}
      FROM (SELECT coalesce(formatted_response, text, solution, content) AS t FROM fields))"""))
def q_stream_stats(spark, sf_dir):
    src, out, ckpt = _folders(spark, "stream-stats")
    _feed(view(spark, sf_dir, "fields"), src, F.col("doc_id") % 3,
          lambda: stats_stream(spark, src, out, ckpt, FIELDS_SCHEMA))
    return read_stats(spark, out)
