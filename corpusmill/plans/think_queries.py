"""Registered think-tag queries F1-F12 over the *tagged* and *fields* views."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.think import close_think, split_response, think_balanced, think_counts
from corpusmill.operators.think import (MAX_THINK_LENGTH, coverage_gate, format_gate,
                                        max_span_length, max_think_length, pick_text_field,
                                        tags_after_truncation, think_span_rows, think_stats,
                                        think_stats_by)
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import view, with_views
from corpusmill.plans.registry import query

# settings of the registered queries
TRUNCATE_AT = 2048


@query("think_counts", with_views(["tagged"], f"""
SELECT doc_id, {Q.count_lit('text', '<think>')} AS opens, {Q.count_lit('text', '</think>')} AS closes
FROM tagged"""))
def q_think_counts(spark, sf_dir):
    opens, closes = think_counts("text")
    return view(spark, sf_dir, "tagged").select("doc_id", opens.alias("opens"), closes.alias("closes"))


@query("think_balanced", with_views(["tagged"], f"""
SELECT doc_id, {Q.count_lit('text', '<think>')} = {Q.count_lit('text', '</think>')} AS balanced
FROM tagged"""))
def q_think_balanced(spark, sf_dir):
    return view(spark, sf_dir, "tagged").select("doc_id", think_balanced("text").alias("balanced"))


@query("think_spans", with_views(["tagged"], f"""
SELECT doc_id, pos, content, CAST(length({Q.strip('content')}) AS BIGINT) AS n_chars
FROM (SELECT doc_id, CAST(generate_subscripts(sp, 1) - 1 AS INTEGER) AS pos, unnest(sp) AS content
      FROM (SELECT doc_id, {Q.spans('text')} AS sp FROM tagged))"""))
def q_think_spans(spark, sf_dir):
    return think_span_rows(view(spark, sf_dir, "tagged"))


@query("pick_text_field", with_views(["fields"], """
SELECT doc_id, coalesce(formatted_response, text, solution, content) AS picked FROM fields"""))
def q_pick_text_field(spark, sf_dir):
    df = view(spark, sf_dir, "fields")
    return df.select("doc_id", pick_text_field(df).alias("picked"))


@query("think_stats", with_views(["fields"], f"""
SELECT {Q.STATS_AGGS}
FROM (SELECT {Q.think_features('t')}
      FROM (SELECT coalesce(formatted_response, text, solution, content) AS t FROM fields))"""))
def q_think_stats(spark, sf_dir):
    return think_stats(view(spark, sf_dir, "fields"))


@query("think_stats_by", with_views(["tagged"], f"""
SELECT lang, grouping(lang) > 0 AS is_total, {Q.STATS_AGGS}
FROM (SELECT lang, {Q.think_features('text')} FROM tagged)
GROUP BY ROLLUP (lang)"""))
def q_think_stats_by(spark, sf_dir):
    return think_stats_by(view(spark, sf_dir, "tagged"), "lang", text="text")


@query("split_response", with_views(["tagged"], f"""
SELECT doc_id,
  CASE WHEN regexp_matches(text, '{Q.SPAN}') THEN {Q.strip(f"regexp_extract(text, '{Q.SPAN}', 1)")} END AS reasoning,
  CASE WHEN strpos(text, '</think>') > 0 THEN {Q.strip("substr(text, strpos(text, '</think>') + 8)")}
       ELSE {Q.strip('text')} END AS answer
FROM tagged"""))
def q_split_response(spark, sf_dir):
    reasoning, answer = split_response("text")
    return view(spark, sf_dir, "tagged").select("doc_id", reasoning.alias("reasoning"), answer.alias("answer"))


@query("close_think", with_views(["tagged"], f"""
SELECT doc_id,
  text || repeat('</think>', CAST(greatest({Q.count_lit('text', '<think>')} - {Q.count_lit('text', '</think>')}, 0) AS BIGINT)) AS closed_text,
  {Q.count_lit('text', '</think>')} > {Q.count_lit('text', '<think>')} AS surplus
FROM tagged"""))
def q_close_think(spark, sf_dir):
    closed, surplus = close_think("text")
    return view(spark, sf_dir, "tagged").select("doc_id", closed.alias("closed_text"), surplus.alias("surplus"))


@query("max_think_length", with_views(["tagged"], f"""
SELECT doc_id, CAST(coalesce(list_max(lens), 0) AS BIGINT) AS max_span_len
FROM (SELECT doc_id, {Q.span_lens('text')} AS lens FROM tagged)
WHERE len(list_filter(lens, lambda x: x > {MAX_THINK_LENGTH})) = 0"""))
def q_max_think_length(spark, sf_dir):
    kept = max_think_length(view(spark, sf_dir, "tagged"), MAX_THINK_LENGTH)
    return kept.select("doc_id", max_span_length("text").alias("max_span_len"))


@query("coverage_gate", with_views(["tagged"], f"""
SELECT round(coalesce(avg(CASE WHEN {Q.count_lit('text', '<think>')} > 0 OR {Q.count_lit('text', '</think>')} > 0
                          THEN 1.0 ELSE 0.0 END), 0.0), 4) AS share,
       coalesce(avg(CASE WHEN {Q.count_lit('text', '<think>')} > 0 OR {Q.count_lit('text', '</think>')} > 0
                    THEN 1.0 ELSE 0.0 END), 0.0) >= 0.9 AS passed
FROM tagged"""))
def q_coverage_gate(spark, sf_dir):
    g = coverage_gate(view(spark, sf_dir, "tagged"))
    return g.select(F.round("share", 4).alias("share"), "passed")


_GATE_SQL = f"""
SELECT doc_id, array_to_string(list_filter([
    CASE WHEN o = 0 AND c = 0 THEN 'no_tags' END,
    CASE WHEN o <> c THEN 'unbalanced' END,
    CASE WHEN o = c AND len(sp) < o THEN 'misordered' END,
    CASE WHEN len(list_filter(lens, lambda x: x > {MAX_THINK_LENGTH})) > 0 THEN 'too_long' END],
  lambda r: r IS NOT NULL), ',') AS reasons
FROM (SELECT doc_id, {Q.count_lit('text', '<think>')} AS o, {Q.count_lit('text', '</think>')} AS c,
             {Q.spans('text')} AS sp, {Q.span_lens('text')} AS lens FROM tagged)"""


@query("format_gate", with_views(["tagged"], f"SELECT doc_id, reasons, reasons = '' AS passed FROM ({_GATE_SQL})"))
def q_format_gate(spark, sf_dir):
    g = format_gate(view(spark, sf_dir, "tagged"))
    return g.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "passed")


@query("tags_after_truncation", with_views(["tagged"], f"""
SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens,
  CAST(len(list_filter(list_slice(tk, 1, {TRUNCATE_AT}), lambda x: x = '<think>')) AS BIGINT) AS kept_opens,
  CAST(len(list_filter(list_slice(tk, 1, {TRUNCATE_AT}), lambda x: x = '</think>')) AS BIGINT) AS kept_closes,
  len(list_filter(tk, lambda x: x = '<think>')) = len(list_filter(tk, lambda x: x = '</think>'))
  AND len(list_filter(list_slice(tk, 1, {TRUNCATE_AT}), lambda x: x = '<think>'))
   <> len(list_filter(list_slice(tk, 1, {TRUNCATE_AT}), lambda x: x = '</think>')) AS broken
FROM (SELECT doc_id, {Q.tokens('text')} AS tk FROM tagged)"""))
def q_tags_after_truncation(spark, sf_dir):
    t = tags_after_truncation(view(spark, sf_dir, "tagged"), TRUNCATE_AT)
    return t.select("doc_id", "n_tokens", "kept_opens", "kept_closes", "broken")
