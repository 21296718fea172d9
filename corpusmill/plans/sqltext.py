"""Shared SQL fragments for the DuckDB twins."""

from __future__ import annotations

from corpusmill.functions.text import sql_literal, sql_strip, sql_ws
from corpusmill.functions.think import span_pattern
from corpusmill.functions.tokens import token_pattern

WS = sql_ws()
SPAN = span_pattern()
TOKEN_RE = token_pattern()


def strip(x: str) -> str:
    return sql_strip(x)


def blank(x: str) -> str:
    return f"coalesce(length({strip(x)}) = 0, true)"


def lit(text: str) -> str:
    return sql_literal(text)


def count_lit(x: str, token: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{token}', ''))) / {len(token)} AS BIGINT)"


def spans(x: str) -> str:
    return f"regexp_extract_all({x}, '{SPAN}', 1)"


def span_lens(x: str) -> str:
    return f"list_transform({spans(x)}, lambda s: CAST(length({strip('s')}) AS BIGINT))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{TOKEN_RE}')"


def think_features(t: str) -> str:
    """Select list: has_text, opens, closes, lens (nulls when no text)."""
    has = f"coalesce(length({t}) > 0, false)"
    return (f"{has} AS has_text, CASE WHEN {has} THEN {count_lit(t, '<think>')} END AS opens, "
            f"CASE WHEN {has} THEN {count_lit(t, '</think>')} END AS closes, "
            f"CASE WHEN {has} THEN {span_lens(t)} END AS lens")


STATS_AGGS = """
  CAST(count(*) AS BIGINT) AS total_samples,
  CAST(count(*) FILTER (WHERE has_text AND (opens > 0 OR closes > 0)) AS BIGINT) AS samples_with_think_tokens,
  CAST(count(*) FILTER (WHERE has_text AND opens = closes AND opens > 0) AS BIGINT) AS samples_with_balanced_tokens,
  CAST(coalesce(sum(opens), 0) AS BIGINT) AS total_think_opens,
  CAST(coalesce(sum(closes), 0) AS BIGINT) AS total_think_closes,
  CAST(coalesce(sum(coalesce(list_sum(lens), 0)) // nullif(sum(len(lens)), 0), 0) AS BIGINT) AS average_think_length"""
