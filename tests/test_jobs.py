"""The three spark-submit jobs, run in-process on sf0.001."""

import json

from pyspark.sql import functions as F

from corpusmill.jobs import prepare, report, rewrite
from corpusmill.plans.fixtures import view
from corpusmill.session import scratch_path
from corpusmill.sources.jsonl import write_jsonl

from .conftest import SF_SMALL

SCHEMA = ("sample_id long, question string, solution string, answer string, text string, "
          "input string, output string, lang string, source string")


def test_prepare_job(spark):
    base = scratch_path(spark, "job-prepare")
    write_jsonl(view(spark, SF_SMALL, "samples"), f"{base}/in")
    prepare.main(["--input", f"{base}/in", "--schema", SCHEMA, "--out", f"{base}/out", "--max-length", "512"])
    batches = spark.read.parquet(f"{base}/out/batches")
    assert batches.count() > 0
    assert batches.filter(F.size("input_ids") != F.col("padded_len")).count() == 0
    plan = spark.read.parquet(f"{base}/out/epochs").select("sample_id", "epoch", F.col("micro_batch").alias("batch_id"))
    assert sorted(batches.select("sample_id", "epoch", "batch_id").collect()) == sorted(plan.collect())
    gate = spark.read.parquet(f"{base}/out/gate")
    dropped = spark.read.parquet(f"{base}/out/dropped")
    assert gate.count() + dropped.count() == view(spark, SF_SMALL, "samples").count()  # every row is accounted for
    assert {r.drop_reason for r in dropped.collect()} == {"incomplete", "unknown"}
    kept = gate.filter("passed AND kind = 'qa'").count()  # a gated row has tags, else it fails
    assert kept > 0 and spark.read.json(f"{base}/out/coverage").first().share == 1.0


def test_prepare_job_with_other_tags(spark, tmp_path):
    """Tags, lists and checks of the settings file reach the whole job."""
    base = scratch_path(spark, "job-tags")
    rows = [(1, "q", "plain reasoning", "a"), (2, "q", "one <r> open", "a"), (3, "q", "<tool_call>x</tool_call> y", "a"), (4, "q", " ", "a")]
    write_jsonl(spark.createDataFrame(rows, "sample_id long, question string, solution string, answer string"), f"{base}/in")
    settings = tmp_path / "s.json"
    settings.write_text(json.dumps({"dataset": {"think_token_start": "<r>", "think_token_end": "</r>"},
                                    "special_tokens": {"keep_tokens": ["<r>", "</r>"], "remove_tokens": ["<tool_call>", "</tool_call>"]},
                                    "training": {"num_train_epochs": 1}, "validation": {"check_think_token_balance": False}}))
    prepare.main(["--input", f"{base}/in", "--schema", "sample_id long, question string, solution string, answer string", "--out", f"{base}/out",
                  "--settings", str(settings), "--require-coverage"])
    gate = {r.sample_id: (r.passed, list(r.reasons)) for r in spark.read.parquet(f"{base}/out/gate").collect()}
    assert gate == {i: (True, []) for i in (1, 2, 3)}
    assert [r.sample_id for r in spark.read.parquet(f"{base}/out/dropped").collect()] == [4]
    vocab = {r.token: r for r in spark.read.parquet(f"{base}/out/vocab").collect()}
    assert vocab["<r>"].freq == vocab["</r>"].freq == 4 and vocab["<r>"].is_special  # the open tag of row 2 was closed
    assert "tool_call" not in vocab and "<tool_call>" not in vocab and "<|endoftext|>" in vocab
    batches = {r.sample_id: r for r in spark.read.parquet(f"{base}/out/batches").collect()}
    assert sorted(batches) == [1, 2, 3]
    pad = vocab["<|endoftext|>"].token_id
    assert all(list(r.input_ids[r.n_tokens:]) == [pad] * (r.padded_len - r.n_tokens) for r in batches.values())
    assert spark.read.json(f"{base}/out/coverage").first().share == 1.0


def test_rewrite_job(spark):
    base = scratch_path(spark, "job-rewrite")
    write_jsonl(view(spark, SF_SMALL, "samples"), f"{base}/in")
    view(spark, SF_SMALL, "lexicon").write.parquet(f"{base}/lexicon")
    rewrite.main(["--input", f"{base}/in", "--format", "jsonl", "--schema", SCHEMA, "--name", "org/set",
                  "--out", f"{base}/out", "--n", "50", "--lexicon", f"{base}/lexicon", "--retry-delay", "0"])
    man = spark.read.json(f"{base}/out/manifest").first()
    assert man.n_selected == 50 and man.status == "completed"
    assert man.n_input == view(spark, SF_SMALL, "samples").count()  # observed by the write of the selection
    report_rows = {r.outcome: r.n_samples for r in spark.read.parquet(f"{base}/out/report").collect()}
    outcomes = ("rewritten", "kept_long", "failed")  # the report holds the rows that were called for
    assert [man[f"n_{o}"] for o in outcomes] == [report_rows.get(o, 0) for o in outcomes]
    assert sum(man[f"n_{o}"] for o in (*outcomes, "blank")) == 50
    assert spark.read.text(f"{base}/out/code_switched_org_set_train_50.jsonl").count() == 50


def test_rewrite_job_without_rows(spark):
    base = scratch_path(spark, "job-rewrite-empty")
    view(spark, SF_SMALL, "samples").limit(0).write.parquet(f"{base}/in")
    view(spark, SF_SMALL, "lexicon").write.parquet(f"{base}/lexicon")
    rewrite.main(["--input", f"{base}/in", "--name", "org/set", "--out", f"{base}/out", "--lexicon", f"{base}/lexicon"])
    man = spark.read.json(f"{base}/out/manifest").first()
    assert (man.n_input, man.n_selected, man.n_blank, man.status) == (0, 0, 0, "empty")


def test_report_job(spark):
    base = scratch_path(spark, "job-report")
    view(spark, SF_SMALL, "tagged").write.parquet(f"{base}/in")
    report.main(["--input", f"{base}/in", "--out", f"{base}/out", "--by", "lang"])
    assert spark.read.json(f"{base}/out/think_stats_by").count() == 5


def byte_pairs():
    """The tokenizer of a user: a public rank file with its library."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    coder = tiktoken.Encoding("user", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return coder.encode_ordinary_batch


def test_prepare_job_with_an_external_tokenizer(spark):
    base = scratch_path(spark, "job-external")
    write_jsonl(view(spark, SF_SMALL, "samples"), f"{base}/in")
    prepare.main(["--input", f"{base}/in", "--schema", SCHEMA, "--out", f"{base}/out", "--max-length", "300",
                  "--tokenizer", "tests.test_jobs:byte_pairs", "--pad-id", "50000"])
    batches = {r.sample_id: r for r in spark.read.parquet(f"{base}/out/batches").filter("epoch = 1").collect()}
    from corpusmill.operators.validate import drop_incomplete_qa, effective_text, format_qa, route_format
    from corpusmill.functions.think import close_think
    from corpusmill.functions.tokens import REMOVE_TOKENS, strip_tokens
    kept = format_qa(drop_incomplete_qa(route_format(view(spark, SF_SMALL, "samples").withColumn("solution", close_think("solution")[0]))))
    texts = {r.sample_id: r.t for r in kept.select("sample_id", strip_tokens(effective_text(kept), REMOVE_TOKENS).alias("t")).collect()}
    encode = byte_pairs()
    assert len(batches) > 50 and set(batches) <= set(texts)
    for key, r in batches.items():
        ids = encode([texts[key]])[0][:300]
        assert list(r.input_ids) == ids + [50000] * (r.padded_len - len(ids)) and r.n_tokens == len(ids)


def test_external_tokens_feed_vocabulary_and_encoder(spark):
    from corpusmill.operators.batches import encode
    from corpusmill.operators.external import external_ids, external_tokens
    from corpusmill.operators.vocab import build_vocab
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c " * 500)], "sample_id long, text string")

    def words():
        return lambda texts: [t.split() for t in texts]

    toks = external_tokens(df, words, slice_bytes=3)
    vocab = build_vocab(toks, special=(), tokens_col="tokens")
    got = {r.sample_id: list(r.input_ids) for r in encode(toks, vocab, tokens_col="tokens").collect()}
    assert got == {1: [1, 2, 1], 2: [], 3: [], 4: [0] * 500}

    def broken():
        return lambda texts: [[1]] * (len(texts) + 1)

    import pytest
    with pytest.raises(Exception, match="answers for"):
        external_ids(df, broken).collect()
