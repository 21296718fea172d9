"""Fingerprints, links and components against brute force."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import simhash_vptree as sim
from corpusmill.llm.graph import components


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1cÀ ", max_size=60))
def test_fingerprint(text):
    assert sim.fingerprint(text) == plain(text)


def brute(points, r):
    root = list(range(len(points)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= r:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def clustered(rng, n, centres, flips):
    c = rng.integers(0, 1 << 63, centres).astype(np.uint64)
    out = c[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


def label(points, pairs):
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {p: find(p) for p in root}


def test_shard_links_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(sim, "LEAF", 16)
    for centres, flips in ((1, 2), (1, 5), (3, 4), (40, 3), (400, 0)):
        points = clustered(rng, 400, centres, flips)
        pairs = [(int(x), int(y)) for a, b in sim.shard_links(points, 4) for x, y in zip(a, b)]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        got = label(points, pairs)
        roots = brute([int(p) for p in points], 4)
        want = {}
        for p, r in zip(points, roots):
            want.setdefault(r, []).append(int(p))
        assert {min(v): sorted(v) for v in want.values()} == {
            r: sorted(p for p in got if got[p] == r) for r in set(got.values())}


def test_trees_prune():
    rng = np.random.default_rng(8)
    shares = []
    for n in (2000, 8000, 32_000):  # one block alike, as in a shard, the other bits random
        points = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) & ~np.uint64(0x1FFF)
        tested = []
        assert not sum(len(a) for a, b in sim.shard_links(np.unique(points), 4, None, tested) if (a != b).any())
        shares.append(sum(tested) / (n * (n - 1) / 2))
    assert shares == sorted(shares, reverse=True) and shares[1] < 0.4 and shares[2] < 0.25
    for n in (2000, 8000, 32_000):
        points = clustered(rng, n, n // 100, 3)
        tested = []
        sim.shard_links(points, 4, None, tested)
        assert sum(tested) < 0.4 * len(points) * (len(points) - 1) / 2
    ball = clustered(rng, 20_000, 1, 4)  # one dense ball: about linear
    tested = []
    sim.shard_links(ball, 4, None, tested)
    assert sum(tested) < 400 * len(ball)


def test_visitors_meet_homes_once_and_never_each_other(monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(sim, "LEAF", 8)
    for centres, flips in ((1, 3), (20, 3), (200, 1)):
        points = clustered(rng, 300, centres, flips)
        homes, visitors = points[::2], points[1::2]
        pairs = [(int(x), int(y)) for a, b in sim.shard_links(homes, 4, visitors) for x, y in zip(a, b) if x != y]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        own = set(map(int, homes))
        assert all(a in own or b in own for a, b in pairs)
        got = label(points, pairs)
        want = {int(p): int(p) for p in points}
        for a in map(int, homes):
            for b in map(int, points):
                if a != b and (a ^ b).bit_count() <= 4:
                    x, y = want[a], want[b]
                    want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
        assert got == want


def test_spark_shards_split_at_vantage_points(spark):
    rng = np.random.default_rng(6)
    far = clustered(rng, 200, 400, 0) & ~np.uint64(0x1FFF)  # one block alike, the rest random
    near = far[:100] ^ (np.uint64(1) << rng.integers(13, 64, 100).astype(np.uint64)) ^ np.uint64(0b101)
    points = np.unique(np.concatenate([far, near, clustered(rng, 100, 2, 6)]))
    fps = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    rows = sim.first_shards(fps, 4)
    split = sim.split_shards(rows, 4, shard_rows=60)
    assert split.select("shard").distinct().count() > rows.select("shard").distinct().count()
    links = sim.link_fingerprints(fps, 4, shard_rows=60).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    got = label(points, [(unsigned(r.a), unsigned(r.b)) for r in links])
    roots = brute([int(p) for p in points], 4)
    assert len(set(got.values())) == len(set(roots))
    assert len({(got[int(p)], r) for p, r in zip(points, roots)}) == len(set(roots))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 150)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(5, base), (3, base), (9, base.upper() + " tail"), (4, "other words entirely here now"), (8, None), (7, ""), (2, " \n"),
            (4, "other words entirely here now"), (None, base)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, key int")
    got = sim.simhash_components(df).collect()
    fps = {i: plain(t) for i, t in rows if i}
    ids = sorted(fps)
    roots = dict(zip(ids, brute([fps[i] for i in ids], 4)))
    first = {r: min(i for i in ids if roots[i] == r) for r in set(roots.values())}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == first[roots[r.doc_id]]
    kept = sim.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, first.values()), "None"])
    assert sim.simhash_components(df.limit(0)).collect() == []


def test_keep_one_where_ids_repeat_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (0, b, "x"), (2, c, "x"), (2, c, "x"), (3, None, "x"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in sim.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (0, b), (2, c), (3, None), (None, a)], key=str)
