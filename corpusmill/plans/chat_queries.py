"""Registered chat-template and conversation queries E1-E7 (*turns*,
*inputs*, *noisy*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.chat import DEFAULT_SYSTEM, IM_END, IM_START, clean_reply, generation_suffix
from corpusmill.operators.conversations import (collect_messages, history_rows, render_conversations, session_segments,
                                                turn_pairs)
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import view, with_views
from corpusmill.plans.registry import query

DEFAULT_BLOCK = f"'{IM_START}system' || chr(10) || {Q.lit(DEFAULT_SYSTEM)} || '{IM_END}' || chr(10)"
RENDERED = {"rendered": f"""
SELECT conv_id,
  coalesce(max(CASE WHEN turn = first_turn AND role = 'system' THEN blk END), {DEFAULT_BLOCK})
  || coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') OR (role = 'system' AND turn > first_turn) THEN blk END, ''
                         ORDER BY turn), '') AS rendered
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn,
        '{IM_START}' || role || chr(10) || coalesce(text, '') || '{IM_END}' || chr(10) AS blk FROM sparse_turns)
GROUP BY conv_id"""}


def _rendered(spark, sf_dir, **kw):
    return render_conversations(view(spark, sf_dir, "sparse_turns"), **kw)


@query("render_chat", with_views(["sparse_turns"], "SELECT conv_id, rendered FROM rendered", RENDERED))
def q_render_chat(spark, sf_dir):
    return _rendered(spark, sf_dir)


def _suffix_sql(think):
    return Q.lit(generation_suffix(True, think))


@query("generation_prompt", with_views(["sparse_turns"], f"""
SELECT conv_id, rendered || {_suffix_sql(True)} AS p_on, rendered || {_suffix_sql(False)} AS p_off,
  rendered || {_suffix_sql(None)} AS p_unset FROM rendered""", RENDERED))
def q_generation_prompt(spark, sf_dir):
    r = render_conversations(view(spark, sf_dir, "sparse_turns"))
    return r.select(
        "conv_id",
        *[F.concat("rendered", F.lit(generation_suffix(True, mode))).alias(name)
          for name, mode in (("p_on", True), ("p_off", False), ("p_unset", None))])


@query("collect_messages", with_views(["turns"], """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
  arg_min(role, turn) AS first_role, md5(string_agg(coalesce(text, ''), chr(1) ORDER BY turn)) AS content_md5
FROM turns GROUP BY conv_id"""))
def q_collect_messages(spark, sf_dir):
    m = collect_messages(view(spark, sf_dir, "turns"))
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.col("messages")[0]["role"].alias("first_role"),
                    F.md5(F.array_join(F.transform("messages", lambda x: F.coalesce(x["content"], F.lit(""))),
                                       "\u0001")).alias("content_md5"))


@query("turn_pairs", with_views(["sparse_turns"], """
SELECT conv_id, turn, text AS user_text, reply_text
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply_text FROM sparse_turns
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'"""))
def q_turn_pairs(spark, sf_dir):
    return turn_pairs(view(spark, sf_dir, "sparse_turns"))


SEGMENTS_SQL = f"""
SELECT user_id, event_id, segment, text FROM (
  SELECT *, CAST(sum(CASE WHEN text = 'clear' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment,
    max(CASE WHEN text = 'exit' THEN 1 ELSE 0 END) OVER w AS closed
  FROM inputs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE closed = 0 AND text <> 'clear' AND NOT {Q.blank('text')}"""


@query("session_segments", with_views(["inputs"], SEGMENTS_SQL))
def q_session_segments(spark, sf_dir):
    return session_segments(view(spark, sf_dir, "inputs")).select("user_id", "event_id", "segment", "text")


@query("clean_reply", with_views(["noisy"], f"""
SELECT doc_id, {Q.strip("replace(replace(replace(text, '<tool_call>', ''), '</tool_call>', ''), '<|im_end|>', '')")} AS cleaned
FROM noisy"""))
def q_clean_reply(spark, sf_dir):
    return view(spark, sf_dir, "noisy").select("doc_id", clean_reply("text").alias("cleaned"))


@query("history_preview", with_views(["turns"], """
SELECT conv_id, turn, role, CASE WHEN role = 'system' AND length(text) > 100 THEN substr(text, 1, 100) || '...'
                                 ELSE text END AS preview
FROM turns WHERE role IN ('system', 'user', 'assistant')"""))
def q_history_preview(spark, sf_dir):
    return history_rows(view(spark, sf_dir, "turns")).select("conv_id", "turn", "role", "preview")
