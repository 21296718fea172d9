"""Training-data job: validate -> route -> close -> format -> gate -> tokenize
-> encode -> epoch plan -> pad -> parquet.

spark-submit --py-files corpusmill.zip corpusmill/jobs/prepare.py --input PATH --format jsonl \
    --schema "sample_id long, question string, solution string, answer string" --out OUT

Writes ``dropped`` (rows without a complete format, with the reason), ``gate``
(reasons and verdict of every formatted row), ``coverage``, ``vocab``,
``epochs`` and ``batches``.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusmill.functions.think import close_think
from corpusmill.functions.tokens import strip_tokens
from corpusmill.jobs.common import load_table
from corpusmill.operators.batches import (PAD_TOKEN, encode, epoch_plan, pad_batch, pad_token_id, padded_lengths,
                                          token_lengths, tokenized)
from corpusmill.operators.external import external_ids
from corpusmill.operators.think import coverage_counts, format_gate, observed_coverage
from corpusmill.operators.validate import drop_reason, effective_text, format_qa, route_format, validate_required
from corpusmill.operators.vocab import add_special_tokens, build_vocab
from corpusmill.session import get_session, scratch_scope, scratch_table
from corpusmill.settings import load_settings

log = logging.getLogger("corpusmill.prepare")


def main(argv=None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="jsonl")
    p.add_argument("--schema")
    p.add_argument("--out", required=True)
    p.add_argument("--key", default="sample_id")
    p.add_argument("--vocab", help="existing vocabulary parquet (token, token_id)")
    p.add_argument("--settings", help="YAML/JSON settings file")
    p.add_argument("--max-length", type=int)
    p.add_argument("--tokenizer", help="package.module:factory of an external tokenizer (texts -> ids); replaces the vocabulary")
    p.add_argument("--pad-id", type=int, help="padding id of the external tokenizer")
    p.add_argument("--require-coverage", action="store_true", help="fail when too few rows hold think tags")
    a = p.parse_args(argv)
    if a.tokenizer and (a.vocab or a.pad_id is None):
        p.error("--tokenizer needs --pad-id and takes no --vocab")
    cfg = load_settings(a.settings)
    spark = get_session()
    with scratch_scope(spark):
        run(spark, a, cfg)


def run(spark, a, cfg) -> None:
    max_length = a.max_length or cfg.max_length
    tags = (cfg.think_start, cfg.think_end)
    # every token that must stay whole: kept, removed and the tags in use
    special = tuple(dict.fromkeys((*cfg.keep_tokens, *tags, PAD_TOKEN, *cfg.remove_tokens)))
    df = load_table(spark, a.input, a.format, a.schema)
    check = validate_required(df).first()
    if not check.valid:
        raise SystemExit(f"input is not valid: {check}")
    routed = route_format(df).withColumn("drop_reason", drop_reason(route_format(df)))
    routed.filter(F.col("drop_reason").isNotNull()).select(a.key, "kind", "drop_reason") \
        .write.mode("overwrite").parquet(f"{a.out}/dropped")
    complete = routed.filter(F.col("drop_reason").isNull())
    if cfg.ensure_think_closure and "solution" in complete.columns:
        # before formatting, so that text and messages hold the same answer
        complete = complete.withColumn("solution", close_think("solution", *tags)[0])
    formatted = format_qa(complete, *tags, key=a.key)
    gated = format_gate(formatted, max_len=cfg.max_think_length, tags=tags, check_balance=cfg.check_think_balance)
    covered = Observation("coverage")  # counted by the write of the gated rows, in its last stage
    gated = scratch_table(gated.observe(covered, *coverage_counts(F.expr("passed AND kind = 'qa'"), tags=tags)), "gated")
    gated.select(a.key, "kind", "reasons", "passed").write.mode("overwrite").parquet(f"{a.out}/gate")
    kept = gated.filter("passed OR kind <> 'qa'")
    observed_coverage(spark, covered, cfg.think_coverage).write.mode("overwrite").json(f"{a.out}/coverage")
    coverage = spark.read.schema("share double, passed boolean").json(f"{a.out}/coverage").first()
    if not coverage.passed:
        if a.require_coverage:
            raise SystemExit(f"think-tag coverage {coverage.share} is below {cfg.think_coverage}")
        log.warning("think-tag coverage %s is below %s", coverage.share, cfg.think_coverage)
    text = strip_tokens(effective_text(kept), cfg.remove_tokens) if cfg.remove_tokens else effective_text(kept)
    texts = kept.select(a.key, text.alias("eff_text"))
    if a.tokenizer:
        # cut already, written once: lengths, plan and batches read the same ids
        toks = scratch_table(external_ids(texts, a.tokenizer, "eff_text", a.key, max_length), "ids")
        ids, pad_id, counted = toks, a.pad_id, "input_ids"
    else:
        toks, counted = tokenized(texts, "eff_text", a.key, special), "tokens"
        if a.vocab:
            vocab = spark.read.parquet(a.vocab)
        else:
            add_special_tokens(build_vocab(toks, special=special, tokens_col="tokens"), (PAD_TOKEN,)) \
                .write.mode("overwrite").parquet(f"{a.out}/vocab")
            vocab = spark.read.parquet(f"{a.out}/vocab")
        ids, pad_id = encode(toks, vocab, key=a.key, tokens_col="tokens", max_length=max_length), pad_token_id(vocab)
    plan = epoch_plan(toks, key=a.key, epochs=cfg.epochs, batch_size=cfg.batch_size, accum=cfg.grad_accum, seed=cfg.seed)
    plan.write.mode("overwrite").parquet(f"{a.out}/epochs")
    batches = padded_lengths(token_lengths(toks, a.key, counted, max_length), spark.read.parquet(f"{a.out}/epochs"), a.key)
    pad_batch(ids, batches, pad_id, key=a.key).write.mode("overwrite").parquet(f"{a.out}/batches")


if __name__ == "__main__":
    main()
