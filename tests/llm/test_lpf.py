"""Repeated passages against brute force over all windows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from corpusmill.llm import lpf_dedup as lpf


def brute(rows, length, keep_first=False):
    """(key, n_bytes, spans, kept) of (key, text) rows."""
    data = [(t or "").encode() for _, t in rows]
    at = defaultdict(list)
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            at[d[p:p + length]].append((i, p))
    out = []
    first = {w: min(((rows[i][0] or 0, data[i], p) for i, p in ps)) for w, ps in at.items()} if keep_first else {}
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            w = d[p:p + length]
            if (keep_first and first[w] != (rows[i][0] or 0, d, p)) or (not keep_first and len(at[w]) > 1):
                gone[p:p + length] = True
        out.append((str(rows[i][0]), len(d), lpf._runs(gone, 0), d[~gone].tobytes() if False else bytes(b for b, g in zip(d, gone) if not g)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect())


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeéfgh ") for _ in range(n))
    passages = [word(rng.randint(30, 260)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, 120)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, "".join(parts)))
    near = list(rows[5][1] + word(300))
    for i in range(60, 70):
        copy = near.copy()
        copy[rng.randrange(len(copy))] = "X"
        rows.append((i, "".join(copy)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, "ab" * 200), (73, "a" * 333), (74, "abc" * 30), (75, "The " * 90), (76, None), (77, "")]
    return rows


def test_windows_share_anchors():
    rng = random.Random(2)
    a = bytes(rng.randrange(256) for _ in range(900))
    b = bytes(rng.randrange(256) for _ in range(57)) + a[100:700] + bytes(50)
    run = lambda d: {i: (h, p - i) for h, s, e, p in lpf.anchor_runs(d, 90) for i in range(s, e)}
    x, y = run(a), run(b)
    assert sorted(x) == list(range(len(a) - 89))
    assert all(x[100 + i] == y[57 + i] for i in range(600 - 89))


def test_prefix_ranks_are_suffix_order():
    rng = random.Random(3)
    d = bytes(rng.choice(b"ab") for _ in range(400))
    rank = lpf.prefix_ranks(np.frombuffer(d, np.uint8), 50)
    whole = range(400 - 49)
    assert sorted(whole, key=lambda i: d[i:i + 50]) == sorted(whole, key=lambda i: rank[i])
    assert all((rank[i] == rank[j]) == (d[i:i + 50] == d[j:j + 50]) for i in whole for j in whole)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_spans_equal_brute_force(spark, keep_first, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(lpf.repeated_spans(df, length=64, keep_first=keep_first, hot_contexts=hot))
    assert got == brute(rows, 64, keep_first)


def test_blocks_of_long_texts(spark, monkeypatch):
    rows = corpus(4)
    whole = "".join(t or "" for _, t in rows)
    monkeypatch.setattr(lpf, "BLOCK", 100)
    assert lpf.contexts(whole.encode(), 64)  # cut into blocks
    runs = list(lpf.anchor_runs(whole.encode(), 64))
    assert [s for _, s, _, _ in runs[1:]] == [e for _, _, e, _ in runs[:-1]] and runs[-1][2] == len(whole.encode()) - 63


def test_edge_rows(spark):
    long = "word and more " * 3 + "x" * 10 + "é" * 40
    rows = [(1, long), (1, long), (None, long + "tail"), (None, "q" * 20), (2, None), (3, ""), (4, "other " * 30)]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, k int, spans string")
    assert found(lpf.repeated_spans(df, length=40)) == brute(rows, 40)
    assert lpf.repeated_spans(df.limit(0)).collect() == []
