import os

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.lexicon import rewrite_text
from corpusmill.operators.rewrite import (apply_verdict, call_sequence, choose_candidate, rewrite_report,
                                          rewrite, run_rewrite)
from tests.scripted import ScriptedTransformer

SOL = "Step one is long. Step two is long."


def _seq(script, max_retries, sleeps=None):
    t = ScriptedTransformer({1: script})
    return call_sequence(1, SOL, t, max_retries, 1.0, "sys", "{text}", "{text}",
                         sleep=(sleeps.append if sleeps is not None else (lambda s: None)))


def test_max_retries_zero_and_one():
    assert _seq(["short"], 0) == []
    log = _seq([SOL + " longer", None], 1)  # too long -> focus (empty) -> out of attempts
    assert [(a, k) for _, a, k, _, _ in log] == [(0, "primary"), (0, "focus")]


def test_backoff_only_after_errors_not_last():
    sleeps = []
    log = _seq([RuntimeError("x"), None, RuntimeError("y"), None, RuntimeError("z")], 3, sleeps)
    assert [s for *_, s, _ in log] == ["error", "error", "error"]
    assert sleeps == [1.0, 2.0]  # no wait after the last attempt


def test_empty_answer_moves_on_without_wait():
    sleeps = []
    log = _seq(["", None, "ok"], 3, sleeps)
    assert len(log) == 2 and sleeps == []


def _verdicts(spark, scripts):
    samples = spark.createDataFrame([(k, SOL, "q", "a", "extra") for k in scripts],
                                    "sample_id long, solution string, question string, answer string, extra string")
    log = rewrite(samples, ScriptedTransformer(scripts), retry_delay=0.0)
    return samples, choose_candidate(samples, log)


def test_accept_rule_scripts(spark):
    L = SOL + " longer"
    scripts = {0: ["short"], 1: [L, "short"], 2: [L, L], 3: ["", None, L], 4: [RuntimeError(), None, RuntimeError(), None, RuntimeError()],
               5: [L, "", "short"], 6: [L, " \n"], 7: [RuntimeError(), None, "", None, "short"]}
    _, v = _verdicts(spark, scripts)
    got = {r.sample_id: r.outcome for r in v.collect()}
    assert got == {0: "rewritten", 1: "rewritten", 2: "kept_long", 3: "kept_long", 4: "failed",
                   5: "rewritten", 6: "failed", 7: "rewritten"}


def test_apply_verdict_shapes(spark):
    samples = spark.createDataFrame([(1, "  keep me  ", None, "a", "x"), (2, "  long one  ", "q", None, "y")],
                                    "sample_id long, solution string, question string, answer string, extra string")
    scripts = {1: [RuntimeError(), None, RuntimeError(), None, RuntimeError()], 2: ["  long one longer  ", "way too long answer"]}
    v = choose_candidate(samples, rewrite(samples, ScriptedTransformer(scripts), retry_delay=0.0))
    out = {r.sample_id: r for r in apply_verdict(samples, v).collect()}
    assert out[1].solution == "  keep me  " and out[1].extra == "x" and out[1].outcome == "failed"
    assert out[2].solution == "long one" and out[2].answer == "" and out[2].extra is None


def test_restart_skips_done_rows(spark, tmp_dir):
    calls = []

    class Counting:
        def __call__(self, req):
            return "s"

    samples = spark.createDataFrame([(i, "text %d here." % i) for i in range(20)], "sample_id long, solution string")
    run_rewrite(samples.filter("sample_id < 10"), Counting(), tmp_dir, retry_delay=0.0)
    log = run_rewrite(samples, Counting(), tmp_dir, retry_delay=0.0)
    assert log.count() == 20 and log.select("sample_id").distinct().count() == 20
    assert calls == []


def test_python_rewrite_matches_spark(spark):
    from corpusmill.operators.lexicon import lexicon_rewrite
    mapping = {"the": "그", "this": "이"}
    texts = ["the cat", "bathe the", "The the,the", "this인 this", "", "é the é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.r for r in df.select(lexicon_rewrite("t", mapping).alias("r")).collect()]
    assert got == [rewrite_text(t, mapping) for t in texts]


def test_system_prompt_file_and_default(tmp_path):
    from corpusmill.operators.rewrite import DEFAULT_SYSTEM_PROMPT, load_system_prompt
    p = tmp_path / "prompt.txt"
    p.write_text("\n  my rules  \n", encoding="utf-8")
    assert load_system_prompt(str(p)) == "my rules"
    assert load_system_prompt(str(tmp_path / "missing.txt")) == DEFAULT_SYSTEM_PROMPT
    assert load_system_prompt(None) == DEFAULT_SYSTEM_PROMPT


def test_build_request_messages(spark):
    from corpusmill.operators.rewrite import build_focus_request, build_request
    df = spark.createDataFrame([(1, "  One. Two!  ")], "sample_id long, solution string")
    r = build_request(df, system=" S ", template="T:{text}").first()
    assert [(m.role, m.content) for m in r.messages] == [("system", "S"), ("user", "T:One. Two!")]
    f = build_focus_request(df, template="{n_sentences}|{budget}|{text}").first()
    assert f.focus_messages[1].content == "2|9|One. Two!"


def test_sentence_alignment_rows_and_rollup(spark):
    from corpusmill.operators.rewrite import sentence_alignment, sentence_alignment_rows
    df = spark.createDataFrame([(1, "Aa bb. Cc dd.", "A. Cc dd longer."), (2, "One. Two.", "One.")],
                               "doc_id long, original string, rewrite string")
    rows = sorted((r.doc_id, r.pos, r.orig_len, r.new_len, r.ok) for r in sentence_alignment_rows(df, "doc_id").collect())
    assert rows == [(1, 0, 5, 1, True), (1, 1, 6, 13, False), (2, 0, 3, 4, False), (2, 1, 4, None, False)]
    roll = {r.doc_id: (r.n_orig, r.n_new, r.n_longer, r.aligned) for r in sentence_alignment(df).collect()}
    assert roll == {1: (2, 2, 1, False), 2: (2, 1, 1, False)}


def test_report_and_manifest(spark):
    from corpusmill.sources.datasets import run_manifest
    v = spark.createDataFrame([("rewritten", 1, 50.0), ("rewritten", 2, 30.0), ("failed", 3, None), ("blank", 0, None)],
                              "outcome string, n_calls long, gain double")
    rep = {r.outcome: (r.n_samples, r.n_calls, r.mean_gain) for r in rewrite_report(v).collect()}
    assert rep == {"rewritten": (2, 3, 40.0), "failed": (1, 3, None), "blank": (1, 0, None), "total": (4, 6, 40.0)}
    m = run_manifest(v, n_input=10, model="m").first()
    assert (m.n_selected, m.n_rewritten, m.n_failed, m.n_blank, m.n_input, m.model, m.status) == (4, 2, 1, 1, 10, "m", "completed")


def test_light_verdict_gives_same_rows(spark):
    L = SOL + " longer"
    scripts = {0: ["short"], 2: [L, L], 3: ["", None, L], 4: [RuntimeError(), None, RuntimeError(), None, RuntimeError()]}
    samples = spark.createDataFrame([(k, "  " + SOL + " ", "q", None) for k in scripts] + [(9, " ", "q", "a")],
                                    "sample_id long, solution string, question string, answer string")
    log = rewrite(samples, ScriptedTransformer(scripts), retry_delay=0.0)
    full = sorted(apply_verdict(samples, choose_candidate(samples, log)).collect())
    light = sorted(apply_verdict(samples, choose_candidate(samples, log, with_original=False)).collect())
    assert full == light
    assert {r.sample_id: r.outcome for r in full} == {0: "rewritten", 2: "kept_long", 3: "kept_long", 4: "failed", 9: "blank"}


class _DiesOnce:
    """Counts its calls in a file; the worker process is lost at one sample
    for as long as ``fuse`` exists."""

    def __init__(self, log, fuse, at):
        self.log, self.fuse, self.at = log, fuse, at

    def __call__(self, request):
        import os
        if request["sample_id"] == self.at and os.path.exists(self.fuse):
            os._exit(1)
        with open(self.log, "a") as fh:
            fh.write(f"{request['sample_id']}\n")
        return "x"


def test_committed_pieces_are_not_called_again(spark, tmp_dir, tmp_path):
    df = spark.createDataFrame([(i, "long enough text") for i in range(400)], "sample_id long, solution string")
    calls, fuse = str(tmp_path / "calls"), str(tmp_path / "fuse")
    open(fuse, "w").close()
    dealt = df.repartition(20, "sample_id").withColumn("part", F.spark_partition_id()).collect()
    part = {r.sample_id: r.part for r in dealt}
    at = max(i for i in part if part[i] == 19)  # the last row of the last task
    transformer = _DiesOnce(calls, fuse, at)
    with pytest.raises(Exception):
        run_rewrite(df, transformer, tmp_dir, task_rows=20, commit_rows=5, max_concurrent=1)
    kept = [r.sample_id for r in spark.read.parquet(tmp_dir).collect()]
    assert len(kept) == len(set(kept)) and at not in kept
    own = sorted(i for i in part if part[i] == 19)
    assert set(own[:(len(own) - 1) // 5 * 5]) <= set(kept)  # all pieces of the lost task but the one at work
    os.truncate(calls, 0)
    os.unlink(fuse)
    done = run_rewrite(df, transformer, tmp_dir, task_rows=20, commit_rows=5, max_concurrent=1)
    assert sorted(int(x) for x in open(calls).read().split()) == sorted(set(part) - set(kept))
    assert sorted(r.sample_id for r in done.collect()) == list(range(400))
    again = run_rewrite(df, transformer, tmp_dir, task_rows=20, commit_rows=5, max_concurrent=1)
    assert again.count() == 400 and len(open(calls).read().split()) == 400 - len(kept)


def test_a_task_run_again_keeps_its_committed_pieces(tmp_path):
    import pandas as pd

    from corpusmill.operators.rewrite import _caller, _commits
    calls, fuse = str(tmp_path / "calls"), str(tmp_path / "fuse")
    (tmp_path / "log").mkdir()
    run = _commits((tmp_path / "log").as_uri(), *_caller(_DiesOnce(calls, fuse, -1), max_concurrent=3), 4)
    frame = pd.DataFrame({"sample_id": range(10), "solution": ["some text"] * 10})
    first = run([frame])
    assert next(first).n[0] == 4  # lost after its first piece
    assert [int(p.n[0]) for p in run([frame])] == [4, 4, 2]
    assert sorted(int(x) for x in open(calls).read().split()) == list(range(10))
    assert not [p for p in os.listdir(tmp_path / "log") if p.startswith("_")]


def test_log_errors_are_not_taken_for_no_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_text("no parquet")
    df = spark.createDataFrame([(1, "text")], "sample_id long, solution string")
    with pytest.raises(Exception):
        run_rewrite(df, ScriptedTransformer({}), str(tmp_path / "log"))


def test_lexicon_attempts_equal_transformer_calls(spark):
    from corpusmill.operators.lexicon import collect_mapping
    from corpusmill.operators.rewrite import LexiconTransformer, lexicon_attempts
    lex = spark.createDataFrame([("let me", "ME", None), ("the", "t", None)], "term string, target string, hybrid string")
    df = spark.createDataFrame([(1, " the the let me "), (2, "none"), (3, "other")], "sample_id long, solution string")
    want = rewrite(df, LexiconTransformer(collect_mapping(lex)), retry_delay=0.0, max_concurrent=1)
    assert sorted(map(tuple, lexicon_attempts(df, lex).collect())) == sorted(map(tuple, want.collect()))


def test_sentence_rows_split_every_text_once(spark):
    from corpusmill.operators.rewrite import sentence_alignment_rows
    df = spark.createDataFrame([(1, "One. Two.", None), (2, None, None), (3, None, "A. Bb! Cc"), (4, " ", ".")], "doc_id long, original string, rewrite string")
    out = sentence_alignment_rows(df, "doc_id")
    assert sorted(tuple(r) for r in out.collect() if r.doc_id < 4) == [
        (1, 0, 3, None, False), (1, 1, 4, None, False), (3, 0, None, 1, False), (3, 1, None, 2, False), (3, 2, None, 2, False)]
    above, generate, below = out._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert generate and "split(" not in above and "split(" in below  # nothing of a text is done again for each of its rows


def test_rewrite_holds_pieces_of_a_batch(monkeypatch):
    import pyarrow as pa

    from corpusmill.operators import rewrite as m
    monkeypatch.setattr(m, "PIECE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"sample_id": list(range(7)), "solution": ["aaaa", "bbbbbb", "c", "d" * 30, None, "그그그", "ee"]})
    pieces = list(m._pieces(batch))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1], [2], [3], [4, 5], [6]]
    assert list(m._pieces(batch.slice(0, 0))) == [] and [p.num_rows for p in m._pieces(batch.slice(3, 3))] == [1, 2]
