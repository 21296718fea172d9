"""Repeated passages by suffix order and longest-previous-factor arrays.

A byte is repeated if a string of ``length`` bytes that covers it starts
anywhere else in the corpus as well (matches stay inside a document).

Anchors keep the suffix sort away from text that occurs once.  The anchor of a
window of ``length`` bytes is its smallest ``GRAM``-byte gram by hash (leftmost
of ties), so windows with equal bytes have equal anchors at equal offsets.  A
document is cut into runs of windows with the same anchor; a run and the bytes
its windows cover are its context.

1. Anchors that occur once in the corpus are dropped.
2. A context that occurs more than once as a whole is repeated.
3. For the other contexts of a shared anchor, the bytes of each distinct
   context are gathered by anchor; a suffix array (prefix doubling up to
   ``length``) puts equal windows side by side.  Where the suffix order has a
   common prefix of ``length`` bytes, a previous or next smaller position
   exists exactly if a position is not the smallest of its stretch: then the
   longest previous factor is at least ``length``.  The mirror image gives the
   longest next factor.
4. Covered bytes are removed: all copies (``keep_first=False``, the previous
   or the next factor reaches ``length``) or later copies only
   (``keep_first=True``, the previous factor does; documents in order of key).

Contexts of one anchor with more than ``hot_contexts`` distinct texts are not
gathered; their windows are counted by hash in a distributed aggregation.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; repeated rows are copies of each other (with ``keep_first`` rows equal
in key and text count as one and lose the same bytes); a null key counts as 0
in the order; an empty table gives an empty table; only the key and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table, text_batches

LENGTH = 200
GRAM = 32
BLOCK = 1 << 20  # bytes of a text handled at a time
CHUNK = 2 << 20  # bytes of contexts sorted at a time, whole anchors
HOT_CONTEXTS = 20_000

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_POSITION = np.uint64(24)  # low bits of a key that hold the position inside a block


# ---- anchors ---------------------------------------------------------------

def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as a big-endian number (zeros after the end)."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(b), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    w, n = _words(b), len(b) - GRAM + 1
    x = w[:n] * _K[0]
    for j in (1, 2, 3):
        x += w[8 * j:8 * j + n] * _K[j]
    x ^= x >> np.uint64(32)
    x *= _K[3]
    return x ^ (x >> np.uint64(29))


def anchor_runs(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, window after the last, anchor position) of
    every run; runs also end where a block of a very long text ends."""
    n_windows = len(data) - length + 1
    for at in range(0, n_windows, BLOCK):
        b = np.frombuffer(data[at:min(at + BLOCK, n_windows) + length - 1], np.uint8)
        g = _gram_hashes(b)
        key = g >> _POSITION << _POSITION | np.arange(len(g), dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[:span - width], key[width - span:])
        p = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
        s = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1])
        e = np.append(s[1:], len(p))
        yield from zip(g[p[s]].view(np.int64).tolist(), (s + at).tolist(), (e + at).tolist(), (p[s] + at).tolist())


def contexts(data: bytes, length: int = LENGTH) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """(anchor, context hash) -> its runs (first, after, position) in a text."""
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for h, s, e, p in anchor_runs(data, length):
        c = xxhash.xxh3_64_intdigest(data[s:e + length - 1], seed=p - s)
        out.setdefault((h, c - (1 << 64) if c >> 63 else c), []).append((s, e, p))
    return out


# ---- suffix order ----------------------------------------------------------

def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` bytes (prefix doubling
    from eight bytes on; beyond the end: zeros)."""
    rank = np.unique(_words(data), return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < length:
        step = min(have, length - have)
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def factor_flags(rank: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): whether a factor of the ranked length starts earlier,
    and later, than each position; ``order`` is the order of the positions.

    In suffix order with ties by position, the stretch of equal rank holds the
    previous smaller positions to the left and larger ones to the right."""
    by = np.lexsort((order, rank))
    same = rank[by[1:]] == rank[by[:-1]]
    previous, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    previous[by[1:]] = same
    later[by[:-1]] = same
    return previous, later


def repeated_windows(texts: list[bytes], firsts: list[int], counts: list[int], order: list, length: int,
                     keep_first: bool) -> list[list[tuple[int, int]]]:
    """Runs of repeated windows in each context: ``texts[i]`` holds ``counts[i]``
    windows, the first of which starts at ``firsts[i]``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    n = np.array(counts)
    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=order.__getitem__)] = np.arange(len(texts))
    previous, later = factor_flags(prefix_ranks(data, length)[at], np.repeat(place, n) * (1 << 32) + at - np.repeat(begin, n))
    hit = previous if keep_first else previous | later
    return [_runs(part, first) for part, first in zip(np.split(hit, np.cumsum(n)[:-1]), firsts)]


def _runs(flags: np.ndarray, first: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip((np.nonzero(edge == 1)[0] + first).tolist(), (np.nonzero(edge == -1)[0] + first).tolist()))


def merge_spans(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the windows of the given runs, maximal."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length - 1))
        else:
            out.append((a, b + length - 1))
    return out


# ---- Spark -----------------------------------------------------------------

_ID = ["k", "t"]


def _identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(key, k, t, text): k and t name a text; rows that share them are equal.
    Second: whether k alone does."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")).alias("k"), body.alias("text"))
    plain = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()
    return named.withColumn("t", F.lit(0).cast("long") if plain else F.xxhash64("text")), plain


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = ["h", "c", "k", "t", "s", "e", "p", "n"]
        for batch in batches:
            rows = []
            for k, t, text in zip(*(batch.column(x).to_pylist() for x in ("k", "t", "text"))):
                data = text.encode()
                if len(data) >= length:
                    rows += [(h, c, k, t, *runs[0], min(2, len(runs))) for (h, c), runs in contexts(data, length).items()]
                if len(rows) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], names)

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """Texts cross the shuffle compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), batch.column("t"), packed], ["key", "k", "t", "z"])

    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("k", T.LongType()),
                           T.StructField("t", T.LongType()), T.StructField("z", T.BinaryType())])
    return docs.select("key", "k", "t", "text").mapInArrow(run, schema)


def _cut_contexts(length: int):
    """Rows of (id, z, wanted contexts) -> the bytes of each context."""
    names = ["h", "k", "t", "s", "e", "edge", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k, t, z, wanted in zip(*(batch.column(x) for x in ("k", "t", "z", "wanted"))):
                data = unpack.decompress(z.as_py())
                rows += [(w["h"], k.as_py(), t.as_py(), w["s"], w["e"], w["edge"], data[w["s"]:w["e"] + length - 1]) for w in wanted.as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], names)

    return run


def _sort_contexts(length: int, keep_first: bool):
    """Sorted by anchor: suffix order over whole anchors, about CHUNK bytes at a time."""
    def solve(rows: list[dict]) -> pa.RecordBatch:
        runs = repeated_windows([r["body"] for r in rows], [r["s"] for r in rows], [r["e"] - r["s"] for r in rows],
                                [(r["k"], r["t"], r["s"]) for r in rows], length, keep_first)
        found = [(r["k"], r["t"], a, b) for r, x in zip(rows, runs) if r["edge"] for a, b in x]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(
            (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k", "t", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= CHUNK and row["h"] != held[-1]["h"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
        if held:
            yield solve(held)

    return run


def _hash_windows(length: int):
    """Windows of hot anchors: one row each, keyed by a hash of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(xxhash.xxh3_128_digest(r["body"][i:i + length]), r["k"], r["t"], r["s"] + i, r["edge"])
                    for r in batch.to_pylist() for i in range(r["e"] - r["s"])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (
                    pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["w", "k", "t", "a", "edge"])

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = False,
                   hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``(key, n_bytes, spans array<struct<start, end>>, kept binary)`` of every
    row: the removed byte spans and the bytes that stay."""
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    named, plain = _identified(docs, key, text)
    anchors = text_batches(named.select("k", "t", "text")).mapInArrow(
        _anchor_rows(length), "h long, c long, k long, t long, s int, e int, p int, n int")
    shared = spill_table(anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "lpf-shared")
    rows = spill_table(anchors.join(shared, "h"), "lpf-anchors")
    # the first occurrence of every distinct context
    kinds = spill_table(rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("k", "t", "s", "e")).alias("first")), "lpf-contexts")
    whole = rows.join(kinds.where("n > 1"), ["h", "c"]).select(
        *(rows[x] for x in ("k", "t", "s", "e")), "first", rows["n"].alias("own"))
    goes = F.struct("k", "t", "s", "e") != F.col("first") if keep_first else F.lit(True)
    whole = whole.select("k", "t", F.col("s").alias("a"), F.col("e").alias("b"), goes.alias("goes"), (F.col("own") > 1).alias("again"))

    edge = F.lit(True) if keep_first else F.col("n") == 1
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(edge).alias("edges")).where("kinds > 1 and edges > 0")
    wanted = spill_table(kinds.join(mixed.select("h", (F.col("kinds") > hot_contexts).alias("hot")), "h")
                         .select("h", "first.k", "first.t", "first.s", "first.e", edge.alias("edge"), "hot"), "lpf-wanted")
    packed = _packed(named)
    by_text = wanted.groupBy(*_ID).agg(F.collect_list(F.struct("h", "s", "e", "edge", "hot")).alias("wanted"))

    def bodies(hot: bool) -> DataFrame:
        some = by_text.select(*_ID, F.filter("wanted", lambda w: w["hot"] == hot).alias("wanted")).where(F.size("wanted") > 0)
        texts = packed if plain else packed.dropDuplicates(_ID)
        return texts.join(some, _ID).select("k", "t", "z", "wanted").mapInArrow(
            _cut_contexts(length), "h long, k long, t long, s int, e int, edge boolean, body binary")

    parts = (bodies(False).repartition("h").sortWithinPartitions("h")
             .mapInArrow(_sort_contexts(length, keep_first), "k long, t long, a int, b int"))
    partly = {"goes": F.lit(True), "again": F.lit(False)}
    windows = whole.where("goes or again").unionByName(parts.withColumns(partly))
    if not wanted.where("hot").isEmpty():
        single = spill_table(bodies(True).mapInArrow(_hash_windows(length), "w binary, k long, t long, a int, edge boolean"), "lpf-windows")
        counts = single.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "t", "a")).alias("first")).where("n > 1")
        hit = single.where("edge").join(spill_table(counts, "lpf-counts"), "w")
        if keep_first:
            hit = hit.where(F.struct("k", "t", "a") != F.col("first"))
        windows = windows.unionByName(hit.select("k", "t", "a", (F.col("a") + 1).alias("b")).withColumns(partly))
    marked = spill_table(windows.groupBy(*_ID).agg(F.collect_list(F.struct("a", "b", "goes", "again")).alias("windows")), "lpf-windows-by-text")
    return _remove(packed.join(marked, _ID, "left").select("key", "z", "windows"), key, length)


def _remove(rows: DataFrame, key: str, length: int) -> DataFrame:
    item = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, spans, kept = [], [], []
            for z, windows in zip(batch.column("z"), batch.column("windows").to_pylist()):
                data = unpack.decompress(z.as_py())
                found = [(w["a"], w["b"]) for w in windows or () if w["goes"]]
                if any(w["again"] for w in windows or ()):  # contexts that repeat inside this text: their other runs
                    found += [(s, e) for runs in contexts(data, length).values() for s, e, _ in runs[1:]]
                cover = merge_spans(found, length)
                ends = [0, *(x for span in cover for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in cover])
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(item)),
                                              pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    schema = T.StructType([
        T.StructField("key", rows.schema["key"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)

