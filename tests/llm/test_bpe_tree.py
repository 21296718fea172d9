"""Tree encoder against the plain library call, and the round trip."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.bpe_tree import TreeBpe, bpe_round_trip, decode_documents, encode_documents, load_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = load_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = TreeBpe(RANKS, public_tokenizers.PATTERN, leaf_chars=5, leaf_bytes=4)

CHARS = st.text(alphabet=st.one_of(st.sampled_from("ab 's'rel\n\t.,12 é漢　 '"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=1500, deadline=None)
@given(CHARS)
def test_tree_equals_library(text):
    ids = TREE.encode(text)
    assert ids == PLAIN.encode_ordinary(text)
    assert TREE.decode(ids) == text.encode()


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="abetion", min_size=1, max_size=80), st.text(alphabet="aA", min_size=1, max_size=80),
                 st.text(alphabet=" \n", min_size=1, max_size=80)))
def test_piece_join_equals_direct_merge(text):
    assert TREE.encode_piece(text.encode()) == PLAIN._encode_single_piece(text.encode())


@pytest.mark.parametrize("text", ["x" * 5000, " " * 5000 + "y", "ab" * 3000, "'s" * 2000, "1" * 4001 + "a", "漢字" * 1500])
def test_long_runs(text):
    coder = TreeBpe(RANKS, public_tokenizers.PATTERN)
    assert coder.encode(text) == PLAIN.encode_ordinary(text)


def test_vocabulary_entries_merge_to_themselves():
    # the pair rule of the byte level needs it
    for token in list(RANKS)[::29]:
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((RANKS.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            assert rank < 1 << 30
            parts[at:at + 2] = [parts[at] + parts[at + 1]]


def test_round_trip_rows(spark):
    rows = [(1, "a  b\n"), (2, None), (3, ""), (4, "é漢 <|endoftext|> 12.5"), (4, "é漢 <|endoftext|> 12.5"), (None, "z")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, ids int, key string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(x := PLAIN.encode_ordinary(t or "")), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows)
    got = bpe_round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe_round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    coded = encode_documents(df, PATH, public_tokenizers.PATTERN)
    decoded = decode_documents(coded, PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.data).decode()) for r in decoded.collect()) == sorted((str(i), t or "") for i, t in rows)
