"""Embedding near-duplicates by E8 lattice hashing.

Vectors are scaled to length 1 and, per table, projected to eight random
orthonormal directions, scaled (by the cosine and the dimension), shifted and decoded to the nearest point of
the E8 lattice, their home cell.  Each vector also visits the ``PROBES``
neighbouring cells nearest to it.  Two vectors meet in a cell that is home to
one and home to, or visited by, the other; the cosine of every pair that meets
is computed in double precision.

Equal vectors of one label are one class with a size, so copies never meet.  A
pair that meets in several cells is counted in one of them only, decided from
the two vectors alone: the first table in which they meet and, there, the
shared home or else the cell in which the larger id is the visitor.  A cell
with more than ``CELL_ROWS`` rows is dealt out as a grid: blocks of about so
many homes against blocks of about so many rows, so that no group grows with
the cell.

Defined results: null, empty or zero vectors, vectors with null or non-finite
components, and rows without a label link with nothing; vectors of different
lengths never link; a null id takes no part (no links, null component, not
kept); rows that repeat an id count as vectors of their own; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import spill_table
from corpusmill.llm.graph import components
from corpusmill.llm.simhash_vptree import _spanning

COSINE = 0.98
TABLES = 4
PROBES = 4
SPREAD = 0.2  # length, in the lattice, of the expected projection of a threshold pair, divided by sqrt(8)
CELL_ROWS = 4096
CHUNK_ROWS = 8192  # rows handled at a time in a task, whole cells
PAIRS = 1 << 16  # pairs tested at a time
SEED = 20_21

# the 240 shortest vectors of E8, doubled so that they are whole numbers
_NEIGHBOURS = np.array(
    [[(2 * s if k == i else 2 * t if k == j else 0) for k in range(8)]
     for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    + [list(signs) for signs in product((1, -1), repeat=8) if signs.count(-1) % 2 == 0], dtype=np.int64)
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) & (1 << 64) - 1 | 1 for i in range(8)], dtype=np.uint64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum."""
    f = np.rint(x)
    off = x - f
    worst = np.abs(off).argmax(axis=1)
    rows = np.nonzero(f.sum(axis=1) % 2 != 0)[0]
    w = worst[rows]
    f[rows, w] += np.where(off[rows, w] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points (n x 8), doubled, as whole numbers."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], half, whole)).astype(np.int64)


def _cell_key(points: np.ndarray, table: int) -> np.ndarray:
    h = (points.astype(np.uint64) * _MIX).sum(axis=-1, dtype=np.uint64) + np.uint64((table + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


@lru_cache(maxsize=8)
def _projection(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim, table))
    q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
    return q[:dim], rng.random(8) * 2


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1 (safe for tiny and huge ones)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cell_scale(dim: int, cosine: float = COSINE) -> float:
    """Vectors at the threshold cosine lie sqrt(2 - 2 cosine) apart, of which
    eight of ``dim`` directions keep sqrt(8 / dim) on average: the scale makes
    that the same share of a cell for every cosine and dimension."""
    return SPREAD * float(np.sqrt(max(dim, 8) / max(2 - 2 * cosine, 1e-6)))


def cells(units: np.ndarray, table: int, probes: int = PROBES, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(home, visited): keys of the home cell and of the nearest neighbours."""
    q, shift = _projection(units.shape[1], table)
    # one dot product at a time and rounded scores: the same cells in whatever batch a vector stands
    x = np.stack([np.einsum("ij,j->i", units, q[:, k]) for k in range(8)], axis=1) * cell_scale(units.shape[1], cosine) + shift
    home = nearest_e8(x)
    toward = np.round((x - home / 2) @ _NEIGHBOURS.T.astype(np.float64), 9)
    best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
    return _cell_key(home, table), _cell_key(home[:, None, :] + _NEIGHBOURS[best], table)


# ---- Spark -----------------------------------------------------------------

def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(label, vector, id, size)``: distinct valid vectors of each label."""
    sound = (F.col("label").isNotNull() & F.col("key").isNotNull() & (F.size("vector") > 0)
             & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
             & F.exists("vector", lambda x: x != 0))
    return (vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
            .where(sound).groupBy("label", "vector").agg(F.min("key").cast("long").alias("id"), F.count(F.lit(1)).alias("size")))


def _address(tables: int, probes: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, units in _by_length(batch.column("vector")):
                for t in range(tables):
                    home, visited = cells(units, t, probes, cosine)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([home, visited.ravel()])), pa.array(np.full(n * (1 + probes), t, np.int32)),
                         pa.array(np.concatenate([np.ones(n, bool), np.zeros(n * probes, bool)])),
                         pa.array(np.concatenate([ids[rows], np.repeat(ids[rows], probes)]))], ["cell", "tab", "home", "id"])

    return run


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector in a list column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    for d in np.unique(lengths):
        rows = np.nonzero(lengths == d)[0]
        yield rows, unit(flat[(ends[rows] - d)[:, None] + np.arange(d)])


def _pairs(group: np.ndarray, home: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all marked rows i with all homes j of the same group, in
    bounded pieces; rows are sorted by group, homes first."""
    start = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1])
    size = np.diff(np.append(start, len(group)))
    homes = np.add.reduceat(home.astype(np.int64), start)
    first, n = np.repeat(start, size), np.repeat(homes, size) * row
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        part = n[at:stop]
        i = np.repeat(np.arange(at, stop), part)
        yield i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        at = stop


def _meet(tables: int, probes: int, cosine: float):
    def chunk_links(group, tab, label, home, row, ids, sizes, units) -> tuple:
        """Counts and spanning links of whole groups: homes against all."""
        by = np.lexsort((~home, group))
        group, tab, label, home, row, ids = group[by], tab[by], label[by], home[by], row[by], ids[by]
        names, one, u = np.unique(ids, return_index=True, return_inverse=True)
        size, units = sizes[by][one], units[by][one]  # each vector once
        known = [cells(units, t, probes, cosine) for t in range(tables)]
        add, links = np.zeros(len(names), np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))
        for i, j in _pairs(group, home, row):
            here = (ids[i] != ids[j]) & (~home[i] | (ids[i] > ids[j])) & (tab[i] == tab[j]) & (label[i] == label[j])
            i, j = i[here], j[here]
            near = np.einsum("ij,ij->i", units[u[i]], units[u[j]]) >= cosine
            t, i, j = tab[i[near]], u[i[near]], u[j[near]]
            new = np.ones(len(i), bool)
            for k in range(tables):
                h, v = known[k]
                ij, ji = (v[i] == h[j][:, None]).any(axis=1), (v[j] == h[i][:, None]).any(axis=1)
                same = h[i] == h[j]
                new &= ~((t > k) & (ij | ji | same))  # met in an earlier table
                # one home, met from both sides, or visits both ways: the larger id is the visitor
                new &= ~((t == k) & (same | ji)) | (names[i] > names[j])
            np.add.at(add, i[new], size[j[new]])
            np.add.at(add, j[new], size[i[new]])
            if len(i):
                links = _spanning(np.concatenate([links[0], i]), np.concatenate([links[1], j]), len(names))
        some = np.nonzero(add)[0]
        a, b = links
        return (np.concatenate([names[some], names[a]]), np.concatenate([add[some], np.zeros(len(a), np.int64)]),
                np.concatenate([names[some], names[b]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            plain = {c: table.column(c).to_numpy() for c in ("grp", "tab", "label", "home", "row", "id", "size")}
            for rows, units in _by_length(table.column("vector").combine_chunks()):
                out = chunk_links(*(plain[c][rows] for c in ("grp", "tab", "label", "home", "row", "id", "size")), units)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id", "n", "other"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted input in pieces of CHUNK_ROWS or more that end where a group ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        group = batch.column("grp").to_numpy()
        cut = int(np.searchsorted(group, group[-1]))  # where the last group of this batch begins
        if rows < CHUNK_ROWS or (cut == 0 and held[0].column("grp")[0].as_py() == group[-1]):
            continue
        whole = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, rows = [batch.slice(cut)], batch.num_rows - cut
        yield whole
    if held:
        yield pa.Table.from_batches(held)


def deal(labelled: DataFrame, cell_rows: int) -> DataFrame:
    """``(tab, grp, home, row, id)``: each cell as a grid of groups of about
    ``cell_rows`` homes (``home``) and ``cell_rows`` rows (``row``); every row
    of the cell meets every home of it in exactly one group."""
    # a cell matters if it is home to a vector and another one meets it there
    busy = spill_table(labelled.groupBy("tab", "label", "cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n"))
                       .where("homes > 0 and n > 1").select("tab", "label", "cell", F.ceil(F.col("homes") / cell_rows).cast("int").alias("blocks"),
                                                            F.ceil(F.col("n") / cell_rows).cast("int").alias("row_blocks")), "busy-cells")
    met = labelled.join(busy, ["tab", "label", "cell"])
    met = met.withColumn("hb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.col("row_blocks")).cast("int"))

    def spot(h: Column, r: Column, home: Column, row: Column) -> Column:
        return F.struct(h.alias("h"), r.alias("r"), home.alias("home"), row.alias("row"))

    as_row = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda h: spot(h, F.col("rb"), F.col("home") & (h == F.col("hb")), F.lit(True)))
    others = F.filter(F.sequence(F.lit(0), F.col("row_blocks") - 1), lambda r: F.col("home") & (r != F.col("rb")))
    as_home = F.transform(others, lambda r: spot(F.col("hb"), r, F.lit(True), F.lit(False)))
    met = met.select("tab", "label", "cell", "id", F.explode(F.concat(as_row, as_home)).alias("s"))
    return met.select("tab", F.xxhash64("tab", "label", "cell", "s.h", "s.r").alias("grp"), "s.home", "s.row", "id")


def lattice_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                  tables: int = TABLES, probes: int = PROBES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(key, n_links, component_id, kept)`` of every row of ``vectors``."""
    kinds = spill_table(classes_of(vectors, key, vector, label), "vector-classes")
    spots = kinds.select("id", "vector").mapInArrow(_address(tables, probes, cosine), "cell long, tab int, home boolean, id long")
    labelled = spill_table(spots.join(kinds.select("id", "label"), "id").select("tab", "label", "cell", "home", "id"), "cells")
    met = deal(labelled, cell_rows)
    full = met.join(kinds, "id").select("grp", "tab", "label", "home", "row", "id", "size", "vector")
    found = spill_table(full.repartition("grp").sortWithinPartitions("grp").mapInArrow(
        _meet(tables, probes, cosine), "id long, n long, other long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = spill_table(
        kinds.join(counts, "id", "left").join(roots, F.col("id") == F.col("vertex"), "left")
        .select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("component_id")), "vector-components")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    out = rows.join(named, (F.col("vector") == F.col("_vector")) & (F.col("label") == F.col("_label")) & F.col("key").isNotNull(), "left")
    component = F.coalesce("component_id", "key").cast(vectors.schema[key].dataType)
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
