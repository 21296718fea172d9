import random
import re


from corpusmill.functions.think import close_think, think_balanced
from corpusmill.operators.think import (format_gate, max_think_length, tags_after_truncation, think_span_rows,
                                        think_stats)


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_balance_edges(spark):
    df = _df(spark, ["no tags", "</think><think>", "<think><think></think>"])
    got = [r.b for r in df.orderBy("doc_id").select(think_balanced("text").alias("b")).collect()]
    assert got == [True, True, False]


def test_spans_newline_and_nested(spark):
    df = _df(spark, ["<think>a\nb</think>", "<think>a<think>b</think>"])
    rows = think_span_rows(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.content) for r in rows] == [(0, "a\nb"), (1, "a<think>b")]


def test_stats_no_spans_and_empty(spark):
    s = think_stats(_df(spark, ["plain", "<think> open only"]), text="text").first()
    assert s.average_think_length == 0 and s.samples_with_think_tokens == 1
    e = think_stats(spark.createDataFrame([], "doc_id long, text string"), text="text").first()
    assert tuple(e) == (0, 0, 0, 0, 0, 0)


def _py_stats(texts):
    """Plain-Python statement of the statistics record."""
    st = dict(total_samples=len(texts), samples_with_think_tokens=0, samples_with_balanced_tokens=0,
              total_think_opens=0, total_think_closes=0, average_think_length=0)
    total = count = 0
    for t in texts:
        if not t:
            continue
        o, c = t.count("<think>"), t.count("</think>")
        st["total_think_opens"] += o
        st["total_think_closes"] += c
        st["samples_with_think_tokens"] += (o > 0 or c > 0)
        st["samples_with_balanced_tokens"] += (o == c and o > 0)
        for m in re.findall(r"<think>(.*?)</think>", t, re.DOTALL):
            total += len(m.strip())
            count += 1
    if count:
        st["average_think_length"] = total // count
    return st


def test_stats_restatement_random(spark):
    rnd = random.Random(3)
    parts = ["<think>", "</think>", " ", "\n", "ab", "c", "　"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 10))) for _ in range(400)] + [None]
    got = think_stats(_df(spark, texts), text="text").first().asDict()
    assert got == _py_stats(texts)


def test_close_think_and_surplus(spark):
    df = _df(spark, ["<think>a<think>b", "a</think>"])
    closed, surplus = close_think("text")
    rows = df.orderBy("doc_id").select(closed.alias("c"), surplus.alias("s")).collect()
    assert rows[0].c == "<think>a<think>b</think></think>" and not rows[0].s
    assert rows[1].c == "a</think>" and rows[1].s


def test_max_think_length_boundary(spark):
    df = _df(spark, ["<think>" + "x" * 8192 + "</think>", "<think>" + "x" * 8193 + "</think>"])
    assert [r.doc_id for r in max_think_length(df, 8192).collect()] == [0]


def test_format_gate_reasons(spark):
    df = _df(spark, ["none", "</think>x<think>", "<think>a</think>"])
    rows = format_gate(df).orderBy("doc_id").collect()
    assert [list(r.reasons) for r in rows] == [["no_tags"], ["misordered"], []]


def test_truncation_cut_before_close(spark):
    df = _df(spark, ["<think> a b </think>"])  # tokens: <think>, a, b, </think>
    r = tags_after_truncation(df, 3).first()
    assert r.broken and r.kept_opens == 1 and r.kept_closes == 0


def test_stats_by_group_matches_per_group(spark):
    df = spark.createDataFrame([(1, "a", "<think>x</think>"), (2, "a", "none"), (3, "b", "<think>yy</think>")],
                               "doc_id long, lang string, text string")
    rows = {r.lang: r for r in think_stats(df, text="text", by="lang").collect()}
    assert rows["a"].total_samples == 2 and rows["b"].average_think_length == 2
    total = [r for r in rows.values() if r.is_total][0]
    assert total.total_samples == 3 and total.samples_with_balanced_tokens == 2


def test_split_response_and_coverage_raise(spark):
    import pytest
    from corpusmill.functions.think import split_response
    from corpusmill.operators.think import coverage_gate
    df = _df(spark, ["<think>\n r \n</think>\n ans ", "no tags here ", "<think>open only"])
    reasoning, answer = split_response("text")
    rows = [(r.a, r.b) for r in df.orderBy("doc_id").select(reasoning.alias("a"), answer.alias("b")).collect()]
    assert rows == [("r", "ans"), (None, "no tags here"), (None, "<think>open only")]
    assert round(coverage_gate(df).first().share, 4) == 0.6667
    with pytest.raises(Exception, match="coverage"):
        coverage_gate(df, 0.9, raise_on_fail=True).collect()
