"""Lattice hashing against brute force: links, components, edge rows."""

import math

import numpy as np
import pytest

from corpusmill.llm import lattice_dedup as lat

from ..conftest import SF_SMALL


def brute(rows, cosine=0.98):
    """{row number: (n_links, component)} of (id, vector, label) rows."""
    sound = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v
             and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i in sound}
    n = dict.fromkeys(range(len(rows)), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    u = {i: np.asarray(rows[i][1], np.float64) for i in sound}
    u = {i: v / np.linalg.norm(v) for i, v in u.items()}
    for a in sound:
        for b in sound:
            if a < b and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine:
                n[a] += 1
                n[b] += 1
                root[find(b)] = find(a)
    least = {}
    for i in sound:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((k, n[i], least[find(i)] if i in root else k) for i, (k, _, _) in enumerate(rows)), key=str)


def found(df):
    got = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_nearest_lattice_point():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    c = lat.nearest_e8(x)
    assert ((c % 2).sum(axis=1) % 8 == 0).all() and (c.sum(axis=1) % 4 == 0).all()
    for step in lat._NEIGHBOURS:
        assert (((x - c / 2) ** 2).sum(axis=1) <= ((x - (c + step) / 2) ** 2).sum(axis=1) + 1e-9).all()
    assert len({tuple(s) for s in lat._NEIGHBOURS.tolist()}) == 240


def cluster_rows():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1):
        for centre in rng.normal(size=(12, 32)):
            for _ in range(int(rng.integers(1, 12))):
                rows.append((k := k + 1, (centre + rng.normal(size=32) * 0.12 * rng.random()).astype(np.float32).tolist(), label))
    rows += [(k + 1 + i, rows[5][1], rows[5][2]) for i in range(20)] + [(900, [2 * x for x in rows[5][1]], 0), (901, rows[5][1], 1)]
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_links_equal_brute_force(spark, cell_rows):
    rows = cluster_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert found(lat.lattice_links(df, cell_rows=cell_rows)) == brute(rows)


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want, got = {k: n for k, n, _ in brute(rows)}, {k: n for k, n, _ in found(lat.lattice_links(df))}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values())


def test_groups_are_bounded_on_both_sides(spark):
    rows = [(0, 0, 7, i < 300, i) for i in range(400)]  # a hot cell: 300 homes, 100 visitors
    cell = spark.createDataFrame(rows, "tab int, label int, cell long, home boolean, id long")
    groups, pairs = {}, []
    for r in lat.deal(cell, 20).collect():
        groups.setdefault(r.grp, []).append(r)
    for rs in groups.values():
        pairs += [(a.id, b.id) for a in rs if a.row for b in rs if b.home]
    assert max(map(len, groups.values())) <= 100
    assert sorted(pairs) == [(a, b) for a in range(400) for b in range(300)]


def planted_recall(dim, low, high, cosine=0.98, n=20_000):
    """Share of random pairs at a cosine between low and high that meet."""
    rng = np.random.default_rng(dim)
    a, b = lat.unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    b = lat.unit(b - (a * b).sum(axis=1)[:, None] * a)
    c = rng.uniform(low, high, n)[:, None]
    b, met = c * a + np.sqrt(1 - c * c) * b, np.zeros(n, bool)
    for t in range(lat.TABLES):
        (ha, va), (hb, vb) = (lat.cells(x, t, cosine=cosine) for x in (a, b))
        met |= (ha == hb) | (va == hb[:, None]).any(axis=1) | (vb == ha[:, None]).any(axis=1)
    return met.mean()


@pytest.mark.parametrize("dim", [4, 8, 16, 32, 64, 256])
def test_recall_at_the_threshold(dim):
    assert planted_recall(dim, 0.98, 0.985) >= 0.99 and planted_recall(dim, 0.9, 0.91, 0.9) >= 0.99


def test_edge_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 0), (2, e, None), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [1.0, float("nan"), 3.0], 0),
            (7, [1.0, float("inf"), 3.0], 0), (None, e, 0), (8, [], 0), (9, [1.0, 2.0], 0), (10, [1e-30, 2e-30, 3e-30], 0), (1, e, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n_links int, id int")
    assert found(lat.lattice_links(df)) == brute(rows)
    assert lat.lattice_links(df.limit(0)).collect() == []


def test_int_keys_and_planted_links_through_the_operator(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 32))
    rows = [(i, [float(x) for x in base[i // 3] + (0 if i % 3 == 0 else 0.02) * rng.normal(size=32)], i // 3 % 4) for i in range(180)]
    cos = np.array([r[1] for r in rows])
    cos /= np.linalg.norm(cos, axis=1)[:, None]
    near = (cos @ cos.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() >= 300  # the table has links
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    got = lat.lattice_links(df)
    assert dict(got.dtypes) == {"vec_id": "int", "n_links": "bigint", "component_id": "int", "kept": "boolean"}
    got = {r.vec_id: r for r in got.collect()}
    assert sum(r.n_links for r in got.values()) >= 0.98 * near.sum()
    assert all(r.n_links <= near[i].sum() for i, r in got.items())
    assert all(r.kept == (r.component_id == i) and r.component_id // 3 == i // 3 for i, r in got.items())
