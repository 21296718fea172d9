"""Registered token, vocabulary and batching queries.

The G family works on the *noisy* corpus (texts with removable special
tokens) and its vocabulary; the H family on the prepared training rows
(samples -> route -> drop incomplete -> format -> effective text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.tokens import KEEP_TOKENS, REMOVE_TOKENS, SPECIAL_TOKENS, THINK_TAGS, strip_tokens, tokenize
from corpusmill.operators.batches import (BATCH_SIZE, EPOCHS, GRAD_ACCUM, LABEL_PAD, MAX_LENGTH, PAD_MULTIPLE, PAD_TOKEN, encode,
                                          epoch_plan, length_profile, pad_batch, pad_token_id, padded_lengths, padding_waste,
                                          token_lengths, tokenized, with_labels)
from corpusmill.operators.validate import effective_text
from corpusmill.operators.vocab import (add_special_tokens, build_vocab, keep_essential, token_audit,
                                        token_diff)
from corpusmill.functions.tokens import special_alternation
from corpusmill.plans import sqltext as Q
from corpusmill.plans.fixtures import view, with_views
from corpusmill.plans.prepare_queries import EFFECTIVE, prepared
from corpusmill.plans.registry import query
from corpusmill.plans.scan import spread
from corpusmill.session import scratch_table

SEED = 42


def _sql_list(tokens) -> str:
    return "[" + ", ".join(f"'{t}'" for t in tokens) + "]"


def vocab_sql(src: str, txt: str) -> str:
    return f"""
SELECT token, CAST(row_number() OVER (ORDER BY (sr = 0), sr, freq DESC, token) - 1 AS BIGINT) AS token_id,
  CAST(freq AS BIGINT) AS freq, sr > 0 AS is_special
FROM (SELECT token, count(*) AS freq, coalesce(list_position({_sql_list(SPECIAL_TOKENS)}, token), 0) AS sr
      FROM (SELECT unnest({Q.tokens(txt)}) AS token FROM {src}) GROUP BY token)"""


G_VOCAB = {"gvocab": vocab_sql("noisy", "text")}
H_CTES = dict(EFFECTIVE)
H_CTES["hvocab"] = vocab_sql("effective", "eff_text")
H_CTES["htok"] = f"""SELECT sample_id, generate_subscripts(tk, 1) - 1 AS pos, unnest(tk) AS token
  FROM (SELECT sample_id, {Q.tokens('eff_text')} AS tk FROM effective)"""
H_CTES["encoded"] = f"""
SELECT e.sample_id, coalesce(x.ids, []) AS ids, coalesce(t.n_all, 0) AS n_all FROM effective e
LEFT JOIN (SELECT sample_id, list(coalesce(v.token_id, -1) ORDER BY pos) AS ids
           FROM htok LEFT JOIN hvocab v USING (token) WHERE pos < {MAX_LENGTH} GROUP BY sample_id) x USING (sample_id)
LEFT JOIN (SELECT sample_id, count(*) AS n_all FROM htok GROUP BY sample_id) t USING (sample_id)"""
PLAN_SQL = f"""
SELECT sample_id, epoch, position, CAST(position // {BATCH_SIZE} AS BIGINT) AS micro_batch,
  CAST(position // {BATCH_SIZE * GRAD_ACCUM} AS BIGINT) AS step
FROM (SELECT sample_id, epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY
        md5('{SEED}' || ':' || CAST(epoch AS VARCHAR) || ':' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS BIGINT) AS position
      FROM effective, (SELECT unnest(range(1, {EPOCHS} + 1)) AS epoch))"""
H_CTES["plan"] = PLAN_SQL
H_CTES["pad"] = f"""
SELECT coalesce((SELECT token_id FROM hvocab WHERE token = '{PAD_TOKEN}'), (SELECT max(token_id) + 1 FROM hvocab), 0) AS pad_id"""
H_CTES["batched"] = f"""
SELECT sample_id, epoch, batch_id, n_tokens, ids,
  CAST(ceil(max(n_tokens) OVER (PARTITION BY epoch, batch_id) / {PAD_MULTIPLE}.0) * {PAD_MULTIPLE} AS BIGINT) AS padded_len
FROM (SELECT sample_id, epoch, micro_batch AS batch_id, CAST(len(ids) AS BIGINT) AS n_tokens, ids FROM encoded JOIN plan USING (sample_id))"""


def g_vocab(spark, sf_dir):
    return build_vocab(view(spark, sf_dir, "noisy"), "text")


def h_corpus(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df.select("sample_id", effective_text(df).alias("eff_text"))


def h_tokens(spark, sf_dir):
    return tokenized(h_corpus(spark, sf_dir), "eff_text", "sample_id")


def h_encoded(spark, sf_dir):
    toks = h_tokens(spark, sf_dir)
    return encode(toks, build_vocab(toks, tokens_col="tokens"), tokens_col="tokens", max_length=MAX_LENGTH)


def h_batches(toks):
    """The micro-batches of the epoch plan with their padded lengths."""
    return padded_lengths(token_lengths(toks, max_length=MAX_LENGTH), epoch_plan(toks, seed=SEED))


def _ids_text(c, sep=" "):
    """The numbers of an array joined by ``sep``: its JSON text, which holds no
    string for each number, with other separators."""
    text = F.to_json(c)
    return F.replace(F.substr(text, F.lit(2), F.octet_length(text) - 2), F.lit(","), F.lit(sep))


@query("keep_essential", with_views(["noisy"], f"""
SELECT token, token_id, (SELECT CAST(count(*) AS BIGINT) FROM gvocab WHERE is_special) AS n_before,
  (SELECT CAST(count(*) AS BIGINT) FROM gvocab WHERE is_special AND token IN (SELECT unnest({_sql_list(KEEP_TOKENS)}))) AS n_after
FROM gvocab WHERE is_special AND token IN (SELECT unnest({_sql_list(KEEP_TOKENS)}))""", G_VOCAB))
def q_keep_essential(spark, sf_dir):
    return keep_essential(g_vocab(spark, sf_dir))


@query("token_diff", with_views(["noisy"], f"""
SELECT coalesce(v.token, e.token) AS token, CAST(coalesce(v.token_id, -1) AS BIGINT) AS token_id,
  CASE WHEN v.token IS NOT NULL AND e.token IS NOT NULL THEN 'kept' WHEN v.token IS NOT NULL THEN 'removed' ELSE 'absent' END AS status
FROM (SELECT token, token_id FROM gvocab WHERE is_special) v
FULL OUTER JOIN (SELECT unnest({_sql_list(KEEP_TOKENS)}) AS token) e USING (token)""", G_VOCAB))
def q_token_diff(spark, sf_dir):
    return token_diff(g_vocab(spark, sf_dir))


# new, half new and already present tags over the whole grown vocabulary
NEW_TOKENS = (*THINK_TAGS, "<|fim_prefix|>")


@query("add_special_tokens", with_views(["noisy"], f"""
SELECT token, token_id, freq, is_special FROM gvocab
UNION ALL
SELECT token, CAST((SELECT max(token_id) FROM gvocab) + row_number() OVER (ORDER BY p) AS BIGINT), 0, true
FROM (SELECT unnest({_sql_list(NEW_TOKENS)}) AS token, unnest(range({len(NEW_TOKENS)})) AS p)
WHERE token NOT IN (SELECT token FROM gvocab)""", G_VOCAB))
def q_add_special_tokens(spark, sf_dir):
    return add_special_tokens(g_vocab(spark, sf_dir), NEW_TOKENS)


@query("token_audit", with_views(["noisy"], f"""
SELECT t.token, CAST(count(*) FILTER (WHERE {Q.count_lit('n.text', 'TOK')} > 0) AS BIGINT) AS n_rows,
  CAST(coalesce(sum({Q.count_lit('n.text', 'TOK')}), 0) AS BIGINT) AS occurrences
FROM (SELECT unnest({_sql_list(REMOVE_TOKENS)}) AS token) t, noisy n GROUP BY t.token"""
    .replace("'TOK'", "t.token").replace("/ 3 AS", "/ length(t.token) AS")))
def q_token_audit(spark, sf_dir):
    return token_audit(view(spark, sf_dir, "noisy"), "text", REMOVE_TOKENS)


@query("strip_tokens", with_views(["noisy"], f"""
SELECT doc_id, regexp_replace(text, '{special_alternation(REMOVE_TOKENS)}', '', 'g') AS stripped FROM noisy"""))
def q_strip_tokens(spark, sf_dir):
    return view(spark, sf_dir, "noisy").select("doc_id", strip_tokens("text", REMOVE_TOKENS).alias("stripped"))


@query("tokenize", with_views(["samples"], f"""
SELECT sample_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS tokens
FROM (SELECT sample_id, {Q.tokens('eff_text')} AS tk FROM effective)""", EFFECTIVE))
def q_tokenize(spark, sf_dir):
    t = tokenize("eff_text", SPECIAL_TOKENS)
    return h_corpus(spark, sf_dir).select("sample_id", F.size(t).cast("bigint").alias("n_tokens"),
                                          F.array_join(t, " ").alias("tokens"))


@query("build_vocab", with_views(["samples"], "SELECT * FROM hvocab", H_CTES))
def q_build_vocab(spark, sf_dir):
    return build_vocab(spread(h_corpus(spark, sf_dir)), "eff_text")


@query("encode", with_views(["samples"], """
SELECT sample_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM encoded""", H_CTES))
def q_encode(spark, sf_dir):
    e = h_encoded(spark, sf_dir)
    return e.select("sample_id", F.size("input_ids").cast("bigint").alias("n_ids"), _ids_text("input_ids").alias("ids"))


@query("labels", with_views(["samples"], """
SELECT sample_id, array_to_string(ids, ' ') AS ids, array_to_string(ids, ' ') AS labels FROM encoded""", H_CTES))
def q_labels(spark, sf_dir):
    e = with_labels(h_encoded(spark, sf_dir))
    return e.select("sample_id", _ids_text("input_ids").alias("ids"), _ids_text("labels").alias("labels"))


@query("pad_batch", with_views(["samples"], f"""
SELECT sample_id, epoch, batch_id, n_tokens, padded_len,
  array_to_string(list_concat(ids, list_transform(range(padded_len - n_tokens), lambda i: pad_id)), ' ') AS input_ids,
  array_to_string(list_concat(ids, list_transform(range(padded_len - n_tokens), lambda i: {LABEL_PAD})), ' ') AS labels,
  repeat('1', CAST(n_tokens AS INT)) || repeat('0', CAST(padded_len - n_tokens AS INT)) AS mask
FROM batched, pad""", H_CTES))
def q_pad_batch(spark, sf_dir):
    toks = h_tokens(spark, sf_dir)
    vocab = scratch_table(add_special_tokens(build_vocab(toks, tokens_col="tokens"), (PAD_TOKEN,)), "vocab")
    enc = encode(toks, vocab, tokens_col="tokens", max_length=MAX_LENGTH)
    b = pad_batch(enc, h_batches(toks), pad_token_id(vocab))
    return b.select("sample_id", "epoch", "batch_id", "n_tokens", "padded_len", _ids_text("input_ids").alias("input_ids"),
                    _ids_text("labels").alias("labels"), _ids_text("attention_mask", "").alias("mask"))


@query("epoch_plan", with_views(["samples"], "SELECT * FROM plan", {**EFFECTIVE, "plan": PLAN_SQL}))
def q_epoch_plan(spark, sf_dir):
    return epoch_plan(h_corpus(spark, sf_dir), seed=SEED)


@query("padding_waste", with_views(["samples"], """
SELECT CAST(CASE WHEN grouping(batch_id) > 0 THEN -1 ELSE epoch END AS BIGINT) AS epoch,
  CAST(CASE WHEN grouping(batch_id) > 0 THEN -1 ELSE batch_id END AS BIGINT) AS batch_id, grouping(batch_id) > 0 AS is_total,
  CAST(sum(n_tokens) AS BIGINT) AS real_tokens, CAST(sum(padded_len) AS BIGINT) AS padded_slots,
  round((sum(padded_len) - sum(n_tokens))::DOUBLE / nullif(sum(padded_len), 0), 4) AS waste
FROM batched GROUP BY GROUPING SETS ((epoch, batch_id), ())""", H_CTES))
def q_padding_waste(spark, sf_dir):
    corpus = h_corpus(spark, sf_dir)
    lengths = scratch_table(corpus.select("sample_id", F.least(F.size(tokenize("eff_text", SPECIAL_TOKENS)), F.lit(MAX_LENGTH))
                                          .alias("n_tokens")), "lengths")  # lengths need no ids
    return padding_waste(padded_lengths(lengths, epoch_plan(lengths, seed=SEED)))


@query("length_profile", with_views(["samples"], f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, round(quantile_cont(n::DOUBLE, 0.5), 4) AS p50,
  round(quantile_cont(n::DOUBLE, 0.9), 4) AS p90, round(quantile_cont(n::DOUBLE, 0.99), 4) AS p99,
  CAST(max(n) AS BIGINT) AS max_len, round(avg(CASE WHEN n > {MAX_LENGTH} THEN 1.0 ELSE 0.0 END), 4) AS share_truncated
FROM (SELECT n_all AS n FROM encoded)""", H_CTES))
def q_length_profile(spark, sf_dir):
    t = h_corpus(spark, sf_dir).select(F.size(tokenize("eff_text", SPECIAL_TOKENS)).alias("n_tokens"))
    return length_profile(t, "n_tokens", MAX_LENGTH)
