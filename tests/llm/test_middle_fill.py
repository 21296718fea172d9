"""Boundary sets and the fill-in-middle transformation against plain slicing."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import middle_fill as mf

P, S, M = "<P>", "<S>", "<M>"


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in (P, S, M)) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, S + suf + P + pre + M + mid, text
    return doc_id, n, "psm", a, b - a, P + pre + S + suf + M + mid, text


TEXTS = {
    "ascii": "abc " * 40_000, "wide": "漢字" * 50_000, "mixed": "aé漢\U0001f600" * 30_000,
    "runs": ("x" * 900 + "\U0001f600" * 300) * 120, "exact": "y" * 65_536, "edge": "y" * 65_535 + "éz",
    "rare": "\U0001f600" * 20_000 + "ab", "empty": "", "one": "é",
}


@pytest.mark.parametrize("name", TEXTS)
def test_select_finds_every_boundary(name):
    text = TEXTS[name]
    bounds = mf.BoundarySet(text.encode())
    want = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert len(bounds) == len(text) + 1
    for k in {0, 1, len(text), len(text) // 2, *np.linspace(0, len(text), 60).astype(int).tolist()} - ({1} if not text else set()):
        assert bounds.select(k) == want[k]


def test_all_container_kinds_are_used_and_agree():
    rng = np.random.default_rng(3)
    seen = set()
    for flags in (rng.random(65_536) < 0.02, rng.random(65_536) < 0.5, np.repeat(rng.random(64) < 0.5, 1024), np.ones(65_536, bool)):
        c = mf.container(flags)
        seen.add(type(c))
        members = np.nonzero(flags)[0]
        assert all(c.select(k) == members[k] for k in range(0, len(members), 97))
    assert seen == {mf.ArrayContainer, mf.BitmapContainer, mf.RunContainer}


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.none(), st.integers()), st.text(alphabet=st.sampled_from("<>PSM aé漢\U0001f600\n"), max_size=30))
def test_rows_equal_plain_slicing(doc_id, text):
    seed = f"1:{'' if doc_id is None else doc_id}"
    n, form, prefix, middle, out = mf.transform(text.encode(), seed)
    assert (doc_id, n, form, prefix, middle, out.decode(), mf.restore(out, form).decode()) == plain(doc_id, text)


def test_table(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS.values(), None, "has <S> inside", "short text with words"] * 12)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, form string, n int")
    got = sorted(map(tuple, mf.fill_in_middle(docs).collect()), key=str)
    assert got == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert mf.fill_in_middle(docs.limit(0)).count() == 0
