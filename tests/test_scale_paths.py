"""The ways for data that do not fit a broadcast give the same rows."""

import corpusmill.operators.batches as batches
import corpusmill.operators.lexicon as lexicon
import corpusmill.plans.sizes as sizes
from corpusmill.operators.vocab import build_vocab
from corpusmill.plans.fixtures import table, view

from .conftest import SF_SMALL


def _docs(spark):
    return table(spark, SF_SMALL, "documents").select("doc_id", "text")


def _joins(df):
    """How a plan joins, broadcast hints only."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)")


def test_lexicon_without_broadcast(spark, monkeypatch):
    lex = view(spark, SF_SMALL, "lexicon")
    hinted = lexicon.lexicon_rewrite_table(_docs(spark), "text", "doc_id", lex).select("doc_id", "rewritten")
    small, used = sorted(hinted.collect()), sorted(lexicon.term_usage(_docs(spark), "text", lex).collect())
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    shuffled = lexicon.lexicon_rewrite_table(_docs(spark), "text", "doc_id", lex).select("doc_id", "rewritten")
    assert _joins(hinted) == 1 and _joins(shuffled) == 0
    assert sorted(shuffled.collect()) == small
    assert sorted(lexicon.term_usage(_docs(spark), "text", lex).collect()) == used


def test_encoder_tail_join(spark, monkeypatch):
    docs = _docs(spark).withColumnRenamed("doc_id", "sample_id")
    vocab = build_vocab(docs, "text")
    a = sorted((r.sample_id, list(r.input_ids)) for r in batches.encode(docs, vocab, max_length=300).collect())
    for name, value in (("HEAD_TOKENS", 0), ("HEAD_TOKENS", 50), ("HEAD_TOKEN_BYTES", 2)):
        with monkeypatch.context() as m:
            m.setattr(batches, name, value)  # no, a small and a short-token head
            b = sorted((r.sample_id, list(r.input_ids)) for r in batches.encode(docs, vocab, max_length=300).collect())
        assert a == b
    ids = {r.token: r.token_id for r in vocab.collect()}
    toks = {r.sample_id: list(r.tokens) for r in batches.tokenized(docs, "text", "sample_id").collect()}
    assert dict(a) == {k: [ids[t] for t in ts[:300]] for k, ts in toks.items()}


def test_lexicon_forms_agree(spark):
    """Phrases, hyphens, unchanged terms, overlaps: Column, table and Python."""
    rows = [("let me", "ME", None), ("let", "L", None), ("non-trivial", "hard", None), ("trivial", "easy", None), ("me go", "MG", None),
            ("of the end", "fin", None), ("the", "the", None), ("a b c d e", "abcde", None), ("b c", "bc", None)]
    lex = spark.createDataFrame(rows, "term string, target string, hybrid string")
    mapping = lexicon.collect_mapping(lex)
    texts = ["let me go", "let  me go", "a non-trivial, trivial non- trivial", "of the end of the", "a b c d", "a b c d e b c", "outlet me", "",
             "...", None, "let let me me go", "letme", "the the of the endless end", "b c" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table_form = {r.doc_id: r.rewritten for r in lexicon.lexicon_rewrite_table(df, "text", "doc_id", lex).collect()}
    column_form = {r.doc_id: r.x for r in df.select("doc_id", lexicon.lexicon_rewrite("text", mapping).alias("x")).collect()}
    assert table_form == column_form == {i: lexicon.rewrite_text(t, mapping) for i, t in enumerate(texts)}
    assert table_form[0] == "ME go" and table_form[2] == "a hard, easy non- easy" and table_form[4] == "a bc d"
    usage = {r.term: r.occurrences for r in lexicon.term_usage(df, "text", lex).collect()}
    assert usage["let me"] == 2 and usage["me go"] == 2 and usage["non-trivial"] == 1 and usage["a b c d e"] == 1


def test_bad_lexicons_are_refused(spark):
    import pytest
    df = spark.createDataFrame([(1, "the")], "doc_id int, text string")
    for rows in ([("the", "a", None), ("the", "b", None)], [("-x", "a", None)], [("", "a", None)], [(None, "a", None)]):
        lex = spark.createDataFrame(rows, "term string, target string, hybrid string")
        with pytest.raises(Exception, match="lexicon term"):
            lexicon.lexicon_rewrite_table(df, "text", "doc_id", lex).collect()
    with pytest.raises(ValueError):
        lexicon.collect_mapping(view(spark, SF_SMALL, "lexicon"), limit=2)
    empty = spark.createDataFrame([], "term string, target string, hybrid string")
    assert lexicon.lexicon_rewrite_table(df, "text", "doc_id", empty).first().rewritten == "the"


def test_encoder_shuffles_no_frequent_token(spark, monkeypatch):
    """Only tokens outside the head become rows; repeated and null keys merge."""
    texts = [(1, "the cat the dog"), (2, ""), (3, None), (4, "zebra the yak zebra"), (5, "the one"), (5, "the two the"), (None, "a b")]
    df = spark.createDataFrame(texts, "sample_id long, text string")
    vocab = build_vocab(df, "text").filter("token <> 'yak'")
    ids = {r.token: r.token_id for r in vocab.collect()} | {"yak": -1}
    monkeypatch.setattr(batches, "LOOKUP_ROWS", 2)
    for size in (0, 1, 3, 1 << 16):
        monkeypatch.setattr(batches, "HEAD_TOKENS", size)
        enc = batches.encode(df, vocab)
        got = {r.sample_id: list(r.input_ids) for r in enc.collect()}
        assert got[1] == [ids[t] for t in ("the", "cat", "the", "dog")] and got[4] == [ids[t] for t in ("zebra", "the", "yak", "zebra")]
        assert got[2] == got[3] == [] and got[None] == [ids["a"], ids["b"]]
        assert got[5] == [ids["the"]] * 2 + sorted([ids["one"], ids["two"]]) + [ids["the"]]
    assert "Generate explode" not in enc._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(tail" in enc._jdf.queryExecution().optimizedPlan().toString()  # of the tail alone
