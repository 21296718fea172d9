"""Registered validation, routing, formatting and selection queries (B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.chat import DEFAULT_SYSTEM, IM_END, IM_START
from corpusmill.operators.select import shortest_n, shortest_n_per_group
from corpusmill.operators.validate import (REQUIRED_QA, drop_incomplete_qa, effective_text,
                                           format_qa, missing_fields, rewritable, route_format,
                                           validate_required)
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import view, with_views
from corpusmill.plans.registry import query

# settings of the registered queries
TOP_N = 100
TOP_N_PER_LANG = 10
SAMPLE_COLS = ("sample_id", "question", "solution", "answer", "text", "input", "output", "lang", "source")
STRING_COLS = ("answer", "input", "lang", "output", "question", "solution", "source", "text")

ROUTE_SQL = """CASE WHEN solution IS NOT NULL AND answer IS NOT NULL THEN 'qa'
  WHEN text IS NOT NULL THEN 'text' WHEN input IS NOT NULL AND output IS NOT NULL THEN 'io'
  ELSE 'unknown' END"""
KEEP_SQL = f"""(kind IN ('text', 'io') OR (kind = 'qa' AND NOT ({Q.blank('question')}
  OR {Q.blank('solution')} OR {Q.blank('answer')})))"""
RESPONSE_SQL = f"""('<think>' || chr(10) || chr(10) || {Q.strip('solution')} || chr(10) || chr(10)
  || '</think>' || chr(10) || chr(10) || {Q.strip('answer')})"""
ROUTED = {"routed": f"SELECT *, {ROUTE_SQL} AS kind FROM samples"}
KEPT = dict(ROUTED, kept=f"SELECT * FROM routed WHERE {KEEP_SQL}")
FORMATTED = dict(KEPT, formatted=f"""
SELECT sample_id, kind,
  CASE WHEN kind = 'qa' THEN {Q.strip('question')} END AS user_content,
  CASE WHEN kind = 'qa' THEN {RESPONSE_SQL} END AS assistant_content,
  CASE WHEN kind = 'qa' THEN {RESPONSE_SQL} ELSE text END AS text,
  CASE WHEN kind <> 'qa' THEN input END AS input,
  CASE WHEN kind <> 'qa' THEN output END AS output
FROM kept""")


def _block(role: str, content: str) -> str:
    return f"'{IM_START}{role}' || chr(10) || {content} || '{IM_END}' || chr(10)"


RENDERED_QA_SQL = ("(" + _block("system", Q.lit(DEFAULT_SYSTEM)) + " || " + _block("user", "user_content")
                   + " || " + _block("assistant", "assistant_content") + ")")
EFFECTIVE = dict(FORMATTED, effective=f"""
SELECT sample_id, kind, CASE WHEN kind = 'qa' THEN {RENDERED_QA_SQL} ELSE coalesce(text, '') END AS eff_text
FROM formatted""")


def prepared(spark, sf_dir):
    """samples -> B3 -> B4 -> B5 (shared by B5, B6 and the H family)."""
    return format_qa(drop_incomplete_qa(route_format(view(spark, sf_dir, "samples"))))


@query("missing_columns", with_views(["samples"], """
SELECT sample_id,
  concat_ws(',', CASE WHEN question IS NULL THEN 'question' END, CASE WHEN solution IS NULL THEN 'solution' END,
            CASE WHEN answer IS NULL THEN 'answer' END) AS missing,
  CAST((question IS NULL)::INT + (solution IS NULL)::INT + (answer IS NULL)::INT AS BIGINT) AS n_missing
FROM samples"""))
def q_missing_columns(spark, sf_dir):
    df = view(spark, sf_dir, "samples")
    m = missing_fields(df, REQUIRED_QA)
    return df.select("sample_id", F.array_join(m, ",").alias("missing"), F.size(m).cast("bigint").alias("n_missing"))


@query("validate_required", with_views(["samples"], """
SELECT count(*) > 0 AND count(*) FILTER (WHERE question IS NULL OR solution IS NULL OR answer IS NULL) = 0 AS valid,
  CAST(count(*) AS BIGINT) AS n_rows,
  CAST(min(sample_id) FILTER (WHERE question IS NULL OR solution IS NULL OR answer IS NULL) AS BIGINT) AS first_row,
  arg_min(CASE WHEN question IS NULL THEN 'question' WHEN solution IS NULL THEN 'solution' ELSE 'answer' END, sample_id)
    FILTER (WHERE question IS NULL OR solution IS NULL OR answer IS NULL) AS first_field
FROM samples"""))
def q_validate_required(spark, sf_dir):
    return validate_required(view(spark, sf_dir, "samples"), REQUIRED_QA)


@query("route_format", with_views(["samples"], "SELECT sample_id, kind FROM routed", ROUTED))
def q_route_format(spark, sf_dir):
    return route_format(view(spark, sf_dir, "samples")).select("sample_id", "kind")


@query("drop_incomplete_qa", with_views(["samples"], "SELECT sample_id, kind FROM kept", KEPT))
def q_drop_incomplete_qa(spark, sf_dir):
    return drop_incomplete_qa(route_format(view(spark, sf_dir, "samples"))).select("sample_id", "kind")


@query("format_qa", with_views(["samples"], "SELECT * FROM formatted", FORMATTED))
def q_format_qa(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df.select("sample_id", "kind",
                     F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"),
                     "text", "input", "output")


@query("effective_text", with_views(["samples"], "SELECT * FROM effective", EFFECTIVE))
def q_effective_text(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df.select("sample_id", "kind", effective_text(df).alias("eff_text"))


@query("drop_blank_solution", with_views(["samples"], f"""
SELECT sample_id, NOT {Q.blank('solution')} AS rewritable FROM samples"""))
def q_drop_blank_solution(spark, sf_dir):
    return view(spark, sf_dir, "samples").select("sample_id", rewritable("solution").alias("rewritable"))


def _len_sql(cols) -> str:
    return " + ".join(f"coalesce(length({c}), 0)" for c in cols)


@query("shortest_n", with_views(["samples"], f"""
SELECT {', '.join(SAMPLE_COLS)}, CAST({_len_sql(['solution'])} AS BIGINT) AS total_len
FROM samples ORDER BY total_len, sample_id LIMIT {TOP_N}"""))
def q_shortest_n(spark, sf_dir):
    return shortest_n(view(spark, sf_dir, "samples"), TOP_N, cols=("solution",), length_col="total_len")


@query("shortest_n_all_strings", with_views(["samples"], f"""
SELECT {', '.join(SAMPLE_COLS)}, CAST({_len_sql(STRING_COLS)} AS BIGINT) AS total_len
FROM samples ORDER BY total_len, sample_id LIMIT {TOP_N}"""))
def q_shortest_n_all_strings(spark, sf_dir):
    return shortest_n(view(spark, sf_dir, "samples"), TOP_N, cols=None, length_col="total_len")


@query("shortest_n_per_group", with_views(["samples"], f"""
SELECT {', '.join(SAMPLE_COLS)}, CAST({_len_sql(['solution'])} AS BIGINT) AS total_len
FROM samples
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_len_sql(['solution'])}, sample_id) <= {TOP_N_PER_LANG}"""))
def q_shortest_n_per_group(spark, sf_dir):
    return shortest_n_per_group(view(spark, sf_dir, "samples"), TOP_N_PER_LANG, "lang",
                                cols=("solution",), length_col="total_len")
