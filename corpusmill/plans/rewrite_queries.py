"""Registered rewrite queries D1-D14.

D1-D6 and D13-D14 run over *samples* (and the scripted *candidates* log);
D7-D12 over ``documents`` and the *pairs* fixture below: the original text
(every fourth one with a final-answer line), its lexicon rewrite, and by
``doc_id % 10`` a dropped first sentence (3), altered math spans (5) or a
dropped final-answer line (8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_RUNS, WS_CLASS, split_sentences
from corpusmill.operators.lexicon import (collect_mapping, lexicon_rewrite,
                                          lexicon_rewrite_table, term_usage)
from corpusmill.operators.rewrite import (BOXED, DEFAULT_FOCUS_TEMPLATE, DEFAULT_SYSTEM_PROMPT, LexiconTransformer,
                                          DEFAULT_TEMPLATE, FINAL_ANSWER, MATH_SPAN, OPERATORS,
                                          apply_verdict, build_focus_request, build_request,
                                          choose_candidate, final_answer_kept, gain_of_lengths,
                                          notation_preserved, pair_corpora, rewrite, rewrite_report,
                                          sentence_alignment, sentence_alignment_rows)
from corpusmill.operators.validate import rewritable
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import table, view, with_views
from corpusmill.plans.registry import query

FIRST_SENTENCE = "^[^.!?]*[.!?]+" + WS_CLASS + "+"
FINAL_LINE = r"\n\*\*Final Answer\*\*\n\\boxed\{[^{}]*\}"
SENT_SPLIT_SQL = "[.!?]+" + WS_CLASS + "+"

# ---- SQL pieces --------------------------------------------------------------

INF = "2147483647"
LEX_SQL = f"""
SELECT term, CASE WHEN length(term) <= coalesce(length(target), {INF}) AND length(term) <= coalesce(length(hybrid), {INF}) THEN term
                  WHEN length(target) <= coalesce(length(hybrid), {INF}) THEN target ELSE hybrid END AS chosen
FROM lexicon"""


def match_ctes(src: str, key: str, txt: str, name: str) -> dict[str, str]:
    """CTEs computing ``name_hit(key, pos, run, phrase, word)``: per run the
    chosen forms of the two-word term and of the word that start there.  The
    fixture's phrases cannot overlap each other."""
    return {
        "lex": LEX_SQL,
        f"{name}_runs": f"""SELECT {key}, generate_subscripts(r, 1) AS pos, unnest(r) AS run
            FROM (SELECT {key}, regexp_extract_all({txt}, '{WORD_RUNS}') AS r FROM {src})""",
        f"{name}_three": f"""SELECT *, run || lead(run, 1) OVER w || lead(run, 2) OVER w AS three FROM {name}_runs
            WINDOW w AS (PARTITION BY {key} ORDER BY pos)""",
        f"{name}_both": f"""SELECT x.{key}, x.pos, x.run, p.chosen AS phrase, p.term AS phrase_term, s.chosen AS word, s.term AS word_term
            FROM {name}_three x LEFT JOIN lex p ON x.three = p.term LEFT JOIN lex s ON x.run = s.term""",
        f"{name}_hit": f"""SELECT *, lag(phrase, 1) OVER w IS NOT NULL OR lag(phrase, 2) OVER w IS NOT NULL AS inside FROM {name}_both
            WINDOW w AS (PARTITION BY {key} ORDER BY pos)""",
    }


def rewrite_ctes(src: str, key: str, txt: str, name: str) -> dict[str, str]:
    """CTEs computing ``name(key, rewritten)``: the lexicon rewrite of
    ``src.txt``, by runs, position and an ordered string_agg."""
    return match_ctes(src, key, txt, name) | {
        f"{name}_agg": f"""SELECT {key}, string_agg(CASE WHEN inside THEN '' ELSE coalesce(phrase, word, run) END, '' ORDER BY pos) AS rewritten
            FROM {name}_hit GROUP BY {key}""",
        name: f"""SELECT d.{key}, CASE WHEN d.{txt} IS NULL THEN NULL ELSE coalesce(a.rewritten, '') END AS rewritten
            FROM {src} d LEFT JOIN {name}_agg a USING ({key})""",
    }


def sql_sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({Q.strip(x)}, '{SENT_SPLIT_SQL}'), "
            f"lambda s: {Q.strip('s')}), lambda s: length(s) > 0)")


ORIG_SQL = "CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '**Final Answer**' || chr(10) || '\\boxed{' || source || '}' ELSE text END"
PAIRS = {"pairs_src": f"SELECT doc_id, {ORIG_SQL} AS original FROM documents"}
PAIRS.update(rewrite_ctes("pairs_src", "doc_id", "original", "pairs_rw"))
PAIRS["pairs"] = f"""
SELECT p.doc_id, p.original, CASE p.doc_id % 10
  WHEN 3 THEN regexp_replace(r.rewritten, '{FIRST_SENTENCE}', '')
  WHEN 5 THEN regexp_replace(r.rewritten, '{MATH_SPAN}', '$?$', 'g')
  WHEN 8 THEN regexp_replace(r.rewritten, '{FINAL_LINE}', '', 'g')
  ELSE r.rewritten END AS rewrite
FROM pairs_src p JOIN pairs_rw r USING (doc_id)"""

REWRITABLE = {"todo": f"SELECT sample_id, {Q.strip('solution')} AS sol FROM samples WHERE NOT {Q.blank('solution')}"}
VERDICTS = dict(REWRITABLE)
VERDICTS["calls"] = f"""
SELECT c.sample_id, c.attempt * 2 + CASE WHEN c.kind = 'focus' THEN 1 ELSE 0 END AS ord, t.sol,
  {Q.strip('c.text')} AS st, c.text, c.kind, c.attempt, c.status, length(t.sol) AS budget
FROM candidates c JOIN todo t USING (sample_id) WHERE c.attempt < 3"""
VERDICTS["judged"] = """
SELECT *, CASE
    WHEN status <> 'ok' THEN NULL
    WHEN kind = 'primary' AND coalesce(length(st) > 0, false) AND length(st) <= budget THEN 'rewritten'
    WHEN kind = 'primary' AND coalesce(length(st) > 0, false) AND attempt >= 1 THEN 'kept_long'
    WHEN kind = 'focus' AND coalesce(length(text) > 0, false) AND length(st) <= budget AND length(st) = 0 THEN 'failed'
    WHEN kind = 'focus' AND coalesce(length(text) > 0, false) AND length(st) <= budget THEN 'rewritten'
    WHEN kind = 'focus' AND coalesce(length(text) > 0, false) THEN 'kept_long' END AS outcome
FROM calls"""
VERDICTS["verdicts"] = """
SELECT t.sample_id, coalesce(f.outcome, 'failed') AS outcome,
  CASE f.outcome WHEN 'rewritten' THEN f.st WHEN 'kept_long' THEN t.sol END AS chosen,
  CAST(coalesce(n.n_calls, 0) AS BIGINT) AS n_calls
FROM todo t
LEFT JOIN (SELECT sample_id, arg_min(outcome, ord) AS outcome, arg_min(st, ord) AS st
           FROM judged WHERE outcome IS NOT NULL GROUP BY sample_id) f USING (sample_id)
LEFT JOIN (SELECT sample_id, count(*) AS n_calls FROM calls GROUP BY sample_id) n USING (sample_id)"""
APPLIED = dict(VERDICTS)
APPLIED["applied"] = """
SELECT s.sample_id,
  CASE WHEN v.outcome IN ('rewritten', 'kept_long') THEN coalesce(s.question, '') ELSE s.question END AS question,
  CASE WHEN v.outcome IN ('rewritten', 'kept_long') THEN v.chosen ELSE s.solution END AS solution,
  CASE WHEN v.outcome IN ('rewritten', 'kept_long') THEN coalesce(s.answer, '') ELSE s.answer END AS answer,
  CASE WHEN coalesce(v.outcome, 'blank') IN ('rewritten', 'kept_long') THEN NULL ELSE s.text END AS text,
  CASE WHEN coalesce(v.outcome, 'blank') IN ('rewritten', 'kept_long') THEN NULL ELSE s.input END AS input,
  CASE WHEN coalesce(v.outcome, 'blank') IN ('rewritten', 'kept_long') THEN NULL ELSE s.output END AS output,
  CASE WHEN coalesce(v.outcome, 'blank') IN ('rewritten', 'kept_long') THEN NULL ELSE s.lang END AS lang,
  CASE WHEN coalesce(v.outcome, 'blank') IN ('rewritten', 'kept_long') THEN NULL ELSE s.source END AS source,
  coalesce(v.outcome, 'blank') AS outcome
FROM samples s LEFT JOIN verdicts v USING (sample_id)"""

# ---- Spark-side fixtures -------------------------------------------------------


def lexicon_mapping(spark, sf_dir):
    return collect_mapping(view(spark, sf_dir, "lexicon"))


def pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    original = F.when(F.col("doc_id") % 4 == 0,
                      F.concat("text", F.lit("\n**Final Answer**\n\\boxed{"), "source", F.lit("}"))) \
        .otherwise(F.col("text"))
    rw = lexicon_rewrite(original, lexicon_mapping(spark, sf_dir))
    rewrite_col = (F.when(F.col("doc_id") % 10 == 3, F.regexp_replace(rw, FIRST_SENTENCE, ""))
                   .when(F.col("doc_id") % 10 == 5, F.regexp_replace(rw, MATH_SPAN, "\\$?\\$"))
                   .when(F.col("doc_id") % 10 == 8, F.regexp_replace(rw, FINAL_LINE, ""))
                   .otherwise(rw))
    return docs.select("doc_id", original.alias("original"), rewrite_col.alias("rewrite"))


def verdicts(spark, sf_dir, with_original=False):
    """Verdicts with lengths; original texts only where a query returns them."""
    return choose_candidate(view(spark, sf_dir, "samples"), view(spark, sf_dir, "candidates"), with_original=with_original)


# ---- registered queries --------------------------------------------------------


@query("build_request", with_views(["samples"], f"""
SELECT sample_id, {Q.lit(DEFAULT_SYSTEM_PROMPT)} AS system_content,
  replace({Q.lit(DEFAULT_TEMPLATE)}, '{{text}}', {Q.strip('solution')}) AS user_content
FROM samples WHERE NOT {Q.blank('solution')}"""))
def q_build_request(spark, sf_dir):
    df = build_request(view(spark, sf_dir, "samples").filter(rewritable()))
    return df.select("sample_id", F.col("messages")[0]["content"].alias("system_content"),
                     F.col("messages")[1]["content"].alias("user_content"))


@query("build_focus_request", with_views(["samples"], f"""
SELECT sample_id, replace(replace(replace({Q.lit(DEFAULT_FOCUS_TEMPLATE)},
    '{{n_sentences}}', CAST(len({sql_sentences('solution')}) AS VARCHAR)),
    '{{budget}}', CAST(length({Q.strip('solution')}) AS VARCHAR)),
    '{{text}}', {Q.strip('solution')}) AS user_content
FROM samples WHERE NOT {Q.blank('solution')}"""))
def q_build_focus_request(spark, sf_dir):
    df = build_focus_request(view(spark, sf_dir, "samples").filter(rewritable()))
    return df.select("sample_id", F.col("focus_messages")[1]["content"].alias("user_content"))


_D3_CTES = dict(REWRITABLE)
_D3_CTES.update(rewrite_ctes("todo", "sample_id", "sol", "todo_rw"))


@query("rewrite_batches", with_views(["samples", "lexicon"], """
SELECT sample_id, 0 AS attempt, 'primary' AS kind, 'ok' AS status, rewritten AS text FROM todo_rw""", _D3_CTES))
def q_rewrite_batches(spark, sf_dir):
    todo = view(spark, sf_dir, "samples").filter(rewritable())
    return rewrite(todo, LexiconTransformer(lexicon_mapping(spark, sf_dir)), retry_delay=0.0, max_concurrent=1)


@query("choose_candidate", with_views(["samples", "candidates"], "SELECT * FROM verdicts", VERDICTS))
def q_choose_candidate(spark, sf_dir):
    return verdicts(spark, sf_dir, with_original=True).select("sample_id", "outcome", "chosen", "n_calls")


@query("apply_verdict", with_views(["samples", "candidates"], "SELECT * FROM applied", APPLIED))
def q_apply_verdict(spark, sf_dir):
    return apply_verdict(view(spark, sf_dir, "samples"), verdicts(spark, sf_dir))


@query("length_gain", with_views(["samples", "candidates"], """
SELECT v.sample_id, CAST(length(t.sol) AS BIGINT) AS orig_len, CAST(length(v.chosen) AS BIGINT) AS new_len,
  round((length(t.sol)::DOUBLE - length(v.chosen)::DOUBLE) / length(t.sol)::DOUBLE * 100.0, 4) AS gain
FROM verdicts v JOIN todo t USING (sample_id) WHERE v.outcome = 'rewritten'""", VERDICTS))
def q_length_gain(spark, sf_dir):
    v = verdicts(spark, sf_dir).filter("outcome = 'rewritten'").withColumn("new_len", F.length("chosen").cast("bigint"))
    return v.select("sample_id", "orig_len", "new_len", F.round(gain_of_lengths("orig_len", "new_len"), 4).alias("gain"))


@query("split_sentences", f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, array_to_string(s, '|') AS sentences
FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)""")
def q_split_sentences(spark, sf_dir):
    s = split_sentences("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.array_join(s, "|").alias("sentences"))


@query("sentence_alignment", with_views(["lexicon"], f"""
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_orig, CAST(len(b) AS BIGINT) AS n_new,
  CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: length(b[i]) > length(a[i]))) AS BIGINT) AS n_longer,
  len(a) = len(b) AND len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: length(b[i]) > length(a[i]))) = 0 AS aligned
FROM (SELECT doc_id, {sql_sentences('original')} AS a, {sql_sentences('rewrite')} AS b FROM pairs)""", PAIRS))
def q_sentence_alignment(spark, sf_dir):
    return sentence_alignment(pairs(spark, sf_dir)).select("doc_id", "n_orig", "n_new", "n_longer", "aligned")


@query("sentence_alignment_rows", with_views(["lexicon"], f"""
SELECT doc_id, CAST(i - 1 AS INT) AS pos, CAST(length(a[i]) AS INT) AS orig_len, CAST(length(b[i]) AS INT) AS new_len,
  coalesce(length(b[i]) <= length(a[i]), false) AS ok
FROM (SELECT doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i
      FROM (SELECT doc_id, {sql_sentences('original')} AS a, {sql_sentences('rewrite')} AS b FROM pairs))""", PAIRS))
def q_sentence_alignment_rows(spark, sf_dir):
    return sentence_alignment_rows(pairs(spark, sf_dir), "doc_id")


_D9_CTES = dict(rewrite_ctes("documents", "doc_id", "text", "docs_rw"))


@query("lexicon_rewrite", with_views(["lexicon"], "SELECT doc_id, rewritten FROM docs_rw", _D9_CTES))
def q_lexicon_rewrite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexicon_rewrite_table(docs, "text", "doc_id", view(spark, sf_dir, "lexicon")).select("doc_id", "rewritten")


@query("term_usage", with_views(["lexicon"], """
SELECT l.term, l.chosen, CAST(coalesce(c.n, 0) AS BIGINT) AS occurrences,
  CAST(coalesce(c.n, 0) * (length(l.term) - length(l.chosen)) AS BIGINT) AS saved_chars
FROM lex l LEFT JOIN (SELECT coalesce(phrase_term, word_term) AS term, count(*) AS n FROM docs_rw_hit WHERE NOT inside GROUP BY 1) c USING (term)""",
    match_ctes("documents", "doc_id", "text", "docs_rw")))
def q_term_usage(spark, sf_dir):
    return term_usage(table(spark, sf_dir, "documents"), "text", view(spark, sf_dir, "lexicon"))


def _bag_sql(x, pattern):
    return f"list_sort(regexp_extract_all({x}, '{pattern}'))"


@query("notation_preserved", with_views(["lexicon"], f"""
SELECT doc_id, m AS math_ok, o AS ops_ok, b AS boxed_ok, m AND o AND b AS preserved
FROM (SELECT doc_id,
        {_bag_sql('original', MATH_SPAN)} = {_bag_sql('rewrite', MATH_SPAN)} AS m,
        {_bag_sql('original', OPERATORS)} = {_bag_sql('rewrite', OPERATORS)} AS o,
        {_bag_sql('original', BOXED)} = {_bag_sql('rewrite', BOXED)} AS b
      FROM pairs)""", PAIRS))
def q_notation_preserved(spark, sf_dir):
    return notation_preserved(pairs(spark, sf_dir)).select("doc_id", "math_ok", "ops_ok", "boxed_ok", "preserved")


@query("final_answer_kept", with_views(["lexicon"], f"""
SELECT doc_id, regexp_matches(original, '{FINAL_ANSWER}') AS has_final,
  NOT regexp_matches(original, '{FINAL_ANSWER}')
  OR (regexp_matches(rewrite, '{FINAL_ANSWER}')
      AND regexp_extract(original, '{FINAL_ANSWER}', 1) = regexp_extract(rewrite, '{FINAL_ANSWER}', 1)) AS kept
FROM pairs""", PAIRS))
def q_final_answer_kept(spark, sf_dir):
    return final_answer_kept(pairs(spark, sf_dir)).select("doc_id", "has_final", "kept")


_REPORT = dict(VERDICTS)
_REPORT["scored"] = """
SELECT v.outcome, v.n_calls,
  CASE WHEN v.outcome = 'rewritten' THEN (length(t.sol)::DOUBLE - length(v.chosen)::DOUBLE) / length(t.sol)::DOUBLE * 100.0 END AS gain
FROM verdicts v JOIN todo t USING (sample_id)
UNION ALL
SELECT 'blank', 0, NULL FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM todo)"""


@query("rewrite_report", with_views(["samples", "candidates"], """
SELECT CASE WHEN grouping(outcome) > 0 THEN 'total' ELSE outcome END AS outcome,
  CAST(count(*) AS BIGINT) AS n_samples, CAST(coalesce(sum(n_calls), 0) AS BIGINT) AS n_calls,
  round(avg(gain), 4) AS mean_gain
FROM scored GROUP BY ROLLUP (outcome)""", _REPORT))
def q_rewrite_report(spark, sf_dir):
    samples = view(spark, sf_dir, "samples")
    gain = F.when(F.col("outcome") == "rewritten", gain_of_lengths("orig_len", F.length("chosen")))
    scored = verdicts(spark, sf_dir).select("outcome", "n_calls", gain.alias("gain"))
    blank = samples.filter(~rewritable()).select(F.lit("blank").alias("outcome"), F.lit(0).cast("bigint").alias("n_calls"),
                                                 F.lit(None).cast("double").alias("gain"))
    return rewrite_report(scored.unionByName(blank))


@query("pair_corpora", with_views(["samples", "candidates"], """
SELECT coalesce(o.sample_id, r.sample_id) AS sample_id, o.solution AS original_solution,
  r.solution AS rewritten_solution,
  CASE WHEN o.sample_id IS NOT NULL AND r.sample_id IS NOT NULL THEN 'both'
       WHEN o.sample_id IS NOT NULL THEN 'original_only' ELSE 'rewritten_only' END AS status,
  coalesce(o.solution IS DISTINCT FROM r.solution, false) AS changed
FROM samples o FULL OUTER JOIN applied r USING (sample_id)""", APPLIED))
def q_pair_corpora(spark, sf_dir):
    samples = view(spark, sf_dir, "samples")
    return pair_corpora(samples, apply_verdict(samples, verdicts(spark, sf_dir)))
