"""Fixture views over the driver tables (FIXTURES.md section 2).

Each view is one SQL text that both Spark and DuckDB run.  On Spark the
table names are bound to DataFrames through ``spark.sql(text, name=df)``; in
the oracle they become a ``WITH`` clause over the pre-registered views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEW_SQL = {
    "samples": """
SELECT doc_id AS sample_id,
  CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN ' ' || chr(10) ELSE 'Q: ' || substr(text, 1, CAST(floor(length(text) / 2) AS INT)) END AS question,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN ' ' || chr(10) WHEN doc_id % 11 = 2 THEN chr(10) || ' ' || text || ' ' ELSE text END AS solution,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS answer,
  CASE WHEN doc_id % 5 = 0 THEN text END AS text,
  CASE WHEN doc_id % 3 = 0 THEN substr(text, CAST(floor(length(text) / 2) AS INT) + 1) END AS input,
  CASE WHEN doc_id % 3 = 0 THEN source END AS output,
  lang, source
FROM {documents}""",
    "tagged": """
SELECT doc_id, lang, CASE doc_id % 7
  WHEN 0 THEN text
  WHEN 1 THEN '<think>' || text
  WHEN 2 THEN text || '</think>'
  WHEN 3 THEN '<think>' || substr(text, 1, CAST(floor(length(text) / 2) AS INT)) || '</think> mid <think>  ' || substr(text, CAST(floor(length(text) / 2) AS INT) + 1) || '  </think> end'
  WHEN 4 THEN '</think>' || text || '<think>'
  WHEN 5 THEN ''
  ELSE '<think>' || chr(10) || chr(10) || text || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || source END AS text
FROM {documents}""",
    "fields": """
SELECT doc_id,
  CASE WHEN doc_id % 4 = 0 THEN text END AS formatted_response,
  CASE WHEN doc_id % 4 = 1 THEN '' END AS text,
  CASE WHEN doc_id % 4 IN (1, 2) THEN text END AS solution,
  CASE WHEN doc_id % 8 = 3 THEN text END AS content
FROM {tagged}""",
    "noisy": """
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN '<tool_call>' || text || '</tool_call><|im_end|> '
  WHEN 1 THEN '<|fim_prefix|>' || text || '<|fim_suffix|><|fim_prefix|>'
  ELSE text END AS text
FROM {documents}""",
    "turns": """
SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 AND turn = 2 THEN 'tool' ELSE role END AS role, text
FROM {conversations}""",
    "sparse_turns": """
SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN turn WHEN 1 THEN turn + 1 WHEN 2 THEN turn * 300 + 2 ELSE turn * 3 END AS turn, role, text
FROM {turns}""",
    "inputs": """
SELECT user_id, ts, event_id, CASE
  WHEN event_type = 'signup' THEN 'clear'
  WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'exit'
  WHEN event_type = 'error' THEN '  '
  ELSE props END AS text
FROM {events}""",
    "lexicon": """
SELECT * FROM (VALUES ('the', '그', NULL), ('with', '와', NULL), ('that', '그', NULL), ('this', '이', 'this인'), ('by', 'by', NULL), ('of', '의것', NULL),
  ('of the', '의', NULL), ('in the', '안에서', 'in그'), ('let me', '내가', NULL), ('non-trivial', '비자명', 'non자명')) AS t(term, target, hybrid)""",
    "candidates": """
SELECT sample_id, attempt, kind, CASE WHEN code = 'X' THEN 'error' ELSE 'ok' END AS status,
  CASE code WHEN 'S' THEN substr(solution, 1, 20) WHEN 'L' THEN solution || ' longer' WHEN 'E' THEN '' WHEN 'B' THEN ' ' || chr(10) END AS text
FROM (
  SELECT sample_id, solution, slot.attempt AS attempt, slot.kind AS kind, substr(CASE sample_id % 8
      WHEN 0 THEN 'S---' WHEN 1 THEN 'LS--' WHEN 2 THEN 'LL--' WHEN 3 THEN 'E-L-'
      WHEN 4 THEN 'X-XX' WHEN 5 THEN 'LES-' WHEN 6 THEN 'LB--' ELSE 'X-ES' END, slot.pos, 1) AS code
  FROM (SELECT sample_id, solution, unnest([{'pos': 1, 'attempt': 0, 'kind': 'primary'}, {'pos': 2, 'attempt': 0, 'kind': 'focus'},
                                             {'pos': 3, 'attempt': 1, 'kind': 'primary'}, {'pos': 4, 'attempt': 2, 'kind': 'primary'}]) AS slot
        FROM {samples} WHERE length(replace(replace(solution, ' ', ''), chr(10), '')) > 0)
) c WHERE code <> '-'""",
}

# Spark text where the dialects differ: the four scripted call slots come
# from a generator over an array literal (``inline`` here, ``unnest`` in
# DuckDB), so neither plan holds a join for them.
SPARK_SQL = {
    "candidates": """
SELECT sample_id, attempt, kind, CASE WHEN code = 'X' THEN 'error' ELSE 'ok' END AS status,
  CASE code WHEN 'S' THEN substr(solution, 1, 20) WHEN 'L' THEN solution || ' longer' WHEN 'E' THEN '' WHEN 'B' THEN ' ' || chr(10) END AS text
FROM (
  SELECT s.sample_id, s.solution, a.attempt, a.kind, substr(CASE s.sample_id % 8
      WHEN 0 THEN 'S---' WHEN 1 THEN 'LS--' WHEN 2 THEN 'LL--' WHEN 3 THEN 'E-L-'
      WHEN 4 THEN 'X-XX' WHEN 5 THEN 'LES-' WHEN 6 THEN 'LB--' ELSE 'X-ES' END, a.pos, 1) AS code
  FROM (SELECT sample_id, solution FROM {samples} WHERE length(replace(replace(solution, ' ', ''), chr(10), '')) > 0) s
  LATERAL VIEW inline(array(named_struct('pos', 1, 'attempt', 0, 'kind', 'primary'),
    named_struct('pos', 2, 'attempt', 0, 'kind', 'focus'), named_struct('pos', 3, 'attempt', 1, 'kind', 'primary'),
    named_struct('pos', 4, 'attempt', 2, 'kind', 'primary'))) a AS pos, attempt, kind
) c WHERE code <> '-'""",
}

VIEW_DEPS = {
    "samples": ("documents",), "tagged": ("documents",), "fields": ("tagged",),
    "noisy": ("documents",), "turns": ("conversations",), "sparse_turns": ("turns",), "inputs": ("events",),
    "lexicon": (), "candidates": ("samples",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view (or base table) as a DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    args = {dep: view(spark, sf_dir, dep) for dep in VIEW_DEPS[name]}
    return spark.sql(SPARK_SQL.get(name, VIEW_SQL[name]), **args)


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in BASE_TABLES or n in seen:
            return
        for d in VIEW_DEPS[n]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(names, body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: ``WITH`` the needed fixture views (plus ``extra`` CTEs,
    which may use them) followed by ``body``."""
    ctes = []
    for n in _closure(names):
        sql = VIEW_SQL[n].strip()
        for dep in VIEW_DEPS[n]:
            sql = sql.replace("{%s}" % dep, dep)
        ctes.append(f"{n} AS ({sql})")
    for n, sql in (extra or {}).items():
        ctes.append(f"{n} AS ({sql.strip()})")
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
