
from corpusmill.functions.tokens import tokenize
from corpusmill.operators.batches import encode, pad_batch, pad_token_id, padded_lengths
from corpusmill.operators.vocab import add_special_tokens, build_vocab, token_audit


def test_tokenize_special_atomic(spark):
    df = spark.createDataFrame([("<think>ab12+<|im_end|> <x",)], "t string")
    assert df.select(tokenize("t").alias("k")).first().k == ["<think>", "ab", "12", "+", "<|im_end|>", "<", "x"]


def test_vocab_order_and_add(spark):
    df = spark.createDataFrame([(1, "b a a <think> c c c"), (2, "b")], "sample_id long, text string")
    v = {r.token: r.token_id for r in build_vocab(df).collect()}
    assert v == {"<think>": 0, "c": 1, "a": 2, "b": 3}
    grown = {r.token: r.token_id for r in add_special_tokens(build_vocab(df)).collect()}
    assert grown["</think>"] == 4 and grown["<think>"] == 0 and len(grown) == 5


def test_encode_cut_and_unknown(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, "")], "sample_id long, text string")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id long")
    got = {r.sample_id: list(r.input_ids) for r in encode(df, vocab, max_length=2).collect()}
    assert got == {1: [0, 1], 2: [0], 3: []}
    got = {r.sample_id: list(r.input_ids) for r in encode(df, vocab, max_length=3).collect()}
    assert got[1] == [0, 1, -1]


def test_encode_repeats_and_hot_unknown_tokens(spark):
    """Positions of repeated tokens in and outside the head, long rows."""
    import random
    rnd = random.Random(2)
    texts = {i: [rnd.choice(["a", "b", "rare", "zz", "x"]) for _ in range(n)] for i, n in enumerate([0, 1, 7, 300, 9000])}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "sample_id long, text string")
    ids = {"a": 0, "b": 1, "rare": 70_000, "zz": 70_001}
    vocab = spark.createDataFrame(list(ids.items()), "token string, token_id long")
    got = {r.sample_id: list(r.input_ids) for r in encode(df, vocab, max_length=8000).collect()}
    assert got == {i: [ids.get(t, -1) for t in ts[:8000]] for i, ts in texts.items()}


def test_pad_batch_lengths(spark):
    rows = [(1, list(range(8))), (2, [1]), (3, list(range(9))), (4, []), (5, []), (6, [])]
    df = spark.createDataFrame(rows, "sample_id long, input_ids array<int>")
    plan = spark.createDataFrame([(k, 1, (k - 1) // 2) for k, _ in rows], "sample_id long, epoch long, micro_batch long")
    lengths = spark.createDataFrame([(k, len(ids)) for k, ids in rows], "sample_id long, n_tokens long")
    out = {r.sample_id: r for r in pad_batch(df, padded_lengths(lengths, plan), 77).collect()}
    assert out[1].padded_len == 8 and out[2].padded_len == 8 and list(out[2].labels) == [1] + [-100] * 7
    assert out[3].padded_len == 16 and out[4].padded_len == 16 and out[5].padded_len == 0
    assert list(out[2].attention_mask) == [1] + [0] * 7 and list(out[2].input_ids) == [1] + [77] * 7


def test_pad_token_must_be_known(spark):
    import pytest
    v = build_vocab(spark.createDataFrame([(1, "a b")], "sample_id long, text string"))
    with pytest.raises(ValueError):
        pad_token_id(v)
    assert pad_token_id(add_special_tokens(v, ("<|endoftext|>",))) == 2


def test_token_audit_zero_counts(spark):
    df = spark.createDataFrame([("<tool_call>x<tool_call>",), ("y",)], "text string")
    got = {r.token: (r.n_rows, r.occurrences) for r in token_audit(df).collect()}
    assert got["<tool_call>"] == (1, 2) and got["<|repo_name|>"] == (0, 0)


def test_special_tokens_that_are_words(spark):
    """A special token that starts with a letter is tried before letter runs,
    wherever it stands; keep_essential sees the vocabulary's counts."""
    from corpusmill.operators.vocab import keep_essential
    df = spark.createDataFrame([(1, "end bending END end")], "sample_id long, text string")
    v = build_vocab(df, special=("end",))
    want = {r.token: r.freq for r in v.collect()}
    assert want["end"] == 2 and keep_essential(v, ("end",)).first().token_id == 0


def test_add_special_tokens_counts(spark):
    both = spark.createDataFrame([(1, "<think> a </think>")], "sample_id long, text string")
    none = spark.createDataFrame([(1, "a b")], "sample_id long, text string")
    for df, added in ((both, 0), (none, 2)):
        v = build_vocab(df)
        grown = add_special_tokens(v)
        assert grown.count() - v.count() == added
    ids = {r.token: r.token_id for r in add_special_tokens(build_vocab(none)).collect()}
    assert (ids["<think>"], ids["</think>"]) == (2, 3)


def test_token_diff_statuses(spark):
    from corpusmill.operators.vocab import token_diff
    vocab = spark.createDataFrame([("<think>", 0, 3, True), ("<tool_call>", 1, 1, True), ("a", 2, 9, False)],
                                  "token string, token_id long, freq long, is_special boolean")
    got = {r.token: (r.token_id, r.status) for r in token_diff(vocab, ("<think>", "<|im_end|>")).collect()}
    assert got == {"<think>": (0, "kept"), "<tool_call>": (1, "removed"), "<|im_end|>": (-1, "absent")}


def test_strip_and_tokenize_random_match_python(spark):
    import random
    import re
    from corpusmill.functions.text import WS
    from corpusmill.functions.tokens import REMOVE_TOKENS, SPECIAL_TOKENS, strip_tokens
    rnd = random.Random(17)
    pool = list(REMOVE_TOKENS[:6]) + ["<think>", "</think>", "<", "|", ">", "ab", "7", " ", "　", ".", "é"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 15))) for _ in range(300)]
    alt = "|".join(re.escape(t) for t in sorted(REMOVE_TOKENS, key=len, reverse=True))
    specials = "|".join(re.escape(t) for t in sorted(SPECIAL_TOKENS, key=len, reverse=True))
    ws = re.escape(WS)
    tok = re.compile(specials + r"|[A-Za-z]+|[0-9]+|[^A-Za-z0-9" + ws + "]")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: (r.s, list(r.k)) for r in df.select("i", strip_tokens("t").alias("s"), tokenize("t").alias("k")).collect()}
    assert rows == {i: (re.sub(alt, "", t), tok.findall(t)) for i, t in enumerate(texts)}
