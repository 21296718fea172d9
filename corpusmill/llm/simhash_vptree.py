"""SimHash near-duplicates through vantage-point trees.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of
``width`` words (all of a shorter text), XXH64 (seed 42); a bit is set if it is
set in over half of the shingles.

Links: distinct fingerprints at ``max_bits`` or fewer differing bits.  The root
of the forest cuts the 64 bits into ``max_bits + 1`` blocks: of any linked pair
at least one block has Hamming distance 0, so each block gives one forest whose
first level sends a fingerprint to the shard at distance 0.  (Vantage points
over all 64 bits from the root on find the same links, but random fingerprints
lie at 32 +- 4 bits, so two thirds of a node are its boundary: copies grow with
the power 0.75 of the rows, where blocks make five at every size.)

Below the root there are vantage-point trees.  A node sends a fingerprint home to
its inner child at distance up to ``mu`` from the vantage point, to its outer
child beyond; one of the outer child within ``max_bits`` of the cut also visits
the inner one, and visitors go on wherever the triangle bound lets them have
partners.  Each node has a vantage point of its own, so the path to a leaf is a
vector of distances that all prune, and a linked pair meets in exactly one leaf
of a tree.  Spark makes these cuts for shards with more than ``SHARD_ROWS``
homes; inside a shard they go on in memory down to leaves of LEAF homes.
Fingerprints within ``max_bits`` of a vantage point are one component through it
and leave the tree.  Every link is tested exactly; a shard emits only as many
links as its components need.

Defined results: null or blank text has fingerprint 0, linked like any other;
a null key has a fingerprint but takes no part in links (component null);
repeated rows and ties share their fingerprint's component; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table, text_batches
from corpusmill.llm.graph import components

WIDTH = 4
MAX_BITS = 4
SEED = 42
SHARD_ROWS = 65_536  # a shard with more homes is split by Spark before it meets one task
LEAF = 64
MAX_ROUNDS = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII case and white space only
    if not words:
        return 0
    body = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        stop = min(n, at + 65_536)
        hashes = np.fromiter((digest(body[s:e - 1], SEED) for s, e in
                              zip(starts[at:stop], ends[min(width, len(words)) - 1 + at:][:stop - at])), np.uint64, stop - at)
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):  # little-endian bytes, lowest bits first
            ones[byte * 8:byte * 8 + 8] += np.bincount(columns[:, byte], minlength=256) @ _BITS
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(key, fp long)``: the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fps.view(np.int64))], ["key", "fp"])

    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)


# ---- shards ----------------------------------------------------------------

def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _vantage(points: np.ndarray) -> np.uint64:
    """The point nearest to the bitwise majority of 255 of them: in a dense
    ball one whose own ball holds most of it."""
    some = points[np.linspace(0, len(points) - 1, 255).astype(int)]
    ones = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    return points[np.argmin(_distance(points, np.packbits(ones > 127, bitorder="little").view(np.uint64)[0]))]


def _cut(homes: np.ndarray, visitors: np.ndarray, r: int) -> tuple[int, int, int]:
    """Distance to cut at, rows of the larger child and fewest homes of a
    child, from the distances of the homes and the visitors of a node."""
    h, v = np.cumsum(np.bincount(homes, minlength=65)), np.cumsum(np.bincount(visitors, minlength=65))
    mu = np.arange(64)
    upto = np.minimum(mu + r, 64)
    beyond = np.where(mu - r >= 0, v[np.maximum(mu - r, 0)], 0)
    most = np.maximum(h[upto] + v[upto], (h[-1] - h[mu]) + (v[-1] - beyond))
    fewest = np.minimum(h[mu], h[-1] - h[mu])
    most = np.where(fewest * 10 >= h[-1], most, np.iinfo(np.int64).max)
    at = int(np.argmin(most))
    return at, int(most[at]), int(fewest[at])


def _divide(homes: np.ndarray, visitors: np.ndarray, dh: np.ndarray, dv: np.ndarray, mu: int, r: int):
    """The two children (homes, visitors) of a cut.  A home goes to one child.
    The boundary visits: a home outside the cut by at most ``r`` visits the
    inner child, a visitor goes wherever the triangle bound lets it have
    partners.  Of any linked pair, one meets the other's home once."""
    inside = dh <= mu
    boundary = ~inside & (dh <= mu + r)
    inner = homes[inside], np.concatenate([homes[boundary], visitors[dv <= mu + r]])
    return inner, (homes[~inside], visitors[dv > mu - r])


def first_shards(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(shard, fp, home)``: one row per block of each distinct fingerprint, at
    home everywhere."""
    blocks, at, keys = max_bits + 1, 0, []
    for i in range(blocks):
        size = (64 - at) // (blocks - i)
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1))
        keys.append(F.xxhash64(F.lit(i), value))
        at += size
    return fps.select(F.explode(F.array(*keys)).alias("shard"), "fp", F.lit(True).alias("home"))


def split_shards(rows: DataFrame, max_bits: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Split shards with more than ``shard_rows`` homes at further vantage points
    until each is small, or no cut makes it smaller (a dense ball, which one
    task handles in linear time)."""
    done: list[DataFrame] = []
    for level in range(MAX_ROUNDS):
        homes = F.count(F.when(F.col("home"), 1))
        full = rows.groupBy("shard").agg(homes.alias("n"), F.min_by("fp", F.when(F.col("home"), F.xxhash64("fp", F.lit(level)))).alias("vantage"))
        full = spill_table(full.where(F.col("n") > shard_rows), "full-shards")
        if full.isEmpty():
            break
        done.append(rows.join(full.select("shard"), "shard", "left_anti"))
        large = rows.join(full, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
        large = spill_table(large.select("shard", "fp", "home", "n", "d"), "large-shards")
        # at most 65 distances a shard; the cut that parts its homes most evenly
        shells = large.where("home").groupBy("shard", "n", "d").agg(F.count(F.lit(1)).alias("c"))
        inner = F.sum("c").over(Window.partitionBy("shard").orderBy("d"))
        cut = (shells.withColumn("worst", F.greatest(inner, F.col("n") - inner))
               .groupBy("shard").agg(F.min_by("d", "worst").alias("mu"), F.min("worst").alias("worst"))
               .withColumnRenamed("shard", "cut_shard"))
        cut = spill_table(cut, "shard-cuts")
        placed = large.join(cut, F.col("shard") == F.col("cut_shard"))
        smaller = F.col("worst") <= F.col("n") * 0.9
        done.append(placed.where(~smaller).select("shard", "fp", "home"))
        inside, d, mu = F.col("d") <= F.col("mu"), F.col("d"), F.col("mu")
        children = F.array(
            F.when(d <= mu + max_bits, F.struct(F.xxhash64("shard", F.lit(0)).alias("shard"), (F.col("home") & inside).alias("home"))),
            F.when(F.when(F.col("home"), ~inside).otherwise(d > mu - max_bits), F.struct(F.xxhash64("shard", F.lit(1)).alias("shard"), F.col("home").alias("home"))))
        split = placed.where(smaller).select(F.explode(F.array_compact(children)).alias("child"), "fp")
        rows = spill_table(split.select("child.shard", "fp", "child.home"), "split-shards")
    for part in done:
        rows = rows.unionByName(part)
    return rows


# ---- inside a shard --------------------------------------------------------

def _leaf_links(p: np.ndarray, q: np.ndarray, r: int, tested: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a leaf's homes, and of homes with visitors, in blocks; a
    dense block gives its spanning links."""
    out = []
    for at in range(0, len(p), LEAF):
        block = p[at:at + LEAF]
        for others, own in ((p[at:], True), (q, False)):
            for lo in range(0, len(others), 65_536):
                part = others[lo:lo + 65_536]
                tested.append(len(block) * len(part))
                i, j = np.nonzero(np.bitwise_count(block[:, None] ^ part[None, :]) <= r)
                if own:
                    new = j + lo > i
                    i, j = i[new], j[new]
                if len(i) > 4 * (len(block) + len(part)):
                    i, j = _spanning(i, j + len(block), len(block) + len(part))
                    both = np.concatenate([block, part])
                    out.append((both[i], both[j]))
                else:
                    out.append((block[i], part[j]))
    return out


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of every vertex to the smallest index of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def shard_links(points: np.ndarray, r: int, visitors: np.ndarray | None = None,
                tested: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly the linked components of distinct points, and
    of these with visitors; ``tested`` gathers how many pairs were compared."""
    tested = [] if tested is None else tested
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(points, points[:0] if visitors is None else visitors)]
    while stack:
        p, q = stack.pop()
        if len(p) <= LEAF:
            if len(p) and len(p) + len(q) > 1:
                out += _leaf_links(p, q, r, tested)
            continue
        vantage = _vantage(p)
        dp, dq = _distance(p, vantage), _distance(q, vantage)
        tested.append(len(p) + len(q))
        ball = p[dp <= r]
        out.append((ball, np.full(len(ball), vantage)))
        # the ball is one component; another point needs one link to it
        shell = np.concatenate([p[(dp > r) & (dp <= 2 * r)], q[dq <= 2 * r]])
        for at in range(0, len(ball), LEAF):
            if not len(shell):
                break
            part = ball[at:at + LEAF]
            tested.append(len(shell) * len(part))
            missed = []
            for lo in range(0, len(shell), 65_536):
                some = shell[lo:lo + 65_536]
                hit = np.bitwise_count(some[:, None] ^ part[None, :]) <= r
                found = hit.any(axis=1)
                out.append((some[found], part[hit[found].argmax(axis=1)]))
                missed.append(some[~found])
            shell = np.concatenate(missed)
        p, dp = p[dp > r], dp[dp > r]
        mu, _, fewest = _cut(dp, dq, r)
        if fewest * 10 >= len(p) > 0:
            stack += _divide(p, q, dp, dq, mu, r)
        elif len(ball) * 50 > len(p):
            stack.append((p, q))
        else:
            out += _leaf_links(p, q, r, tested)
    return out


def _link_shards(max_bits: int):
    def of(shards: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        cuts = np.nonzero(np.diff(shards))[0] + 1
        found = [x for p, own in zip(np.split(fps, cuts), np.split(home, cuts)) for x in shard_links(p[own], max_bits, p[~own])]
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
        real = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[real].view(np.int64)), pa.array(b[real].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by shard: whole shards leave as soon as the next one begins
        held: list[tuple] = []
        for batch in batches:
            shards, fps, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "home"))
            held.append((shards, fps.view(np.uint64), home))
            if len(shards) and held[0][0][0] != shards[-1]:
                shards, fps, home = (np.concatenate(x) for x in zip(*held))
                last = int(np.searchsorted(shards, shards[-1]))
                yield of(shards[:last], fps[:last], home[:last])
                held = [(shards[last:], fps[last:], home[last:])]
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held)))

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)``: links between the distinct fingerprints ``fp`` that join
    exactly those at ``max_bits`` or fewer bits into components."""
    rows = split_shards(spill_table(first_shards(fps, max_bits), "shards"), max_bits, shard_rows)
    return (rows.repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(_link_shards(max_bits), "a long, b long"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                       max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(key, fp, component_id)``: the smallest key reachable over links."""
    prints = spill_table(fingerprints(docs, key, text, width).withColumnRenamed(key, "key"), "fingerprints")
    classes = spill_table(prints.where(F.col("key").isNotNull()).groupBy("fp").agg(F.min("key").alias("first")), "classes")
    roots = spill_table(components(link_fingerprints(classes.select("fp"), max_bits, shard_rows)), "roots")
    rooted = classes.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spill_table(rooted.join(least, "root").select("fp", "component_id"), "named")
    out = prints.join(named, "fp", "left")
    return out.select(F.col("key").alias(key), "fp", F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    key (of rows that repeat a key with different texts, the one with the
    smallest text hash; of rows that repeat both, one).  Rows without a key
    stay."""
    named = docs.where(F.col(key).isNotNull())
    row = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    found = simhash_components(named.select(row.alias("_row"), F.col(text).alias("_text")), "_row", "_text", width, max_bits)
    kept = found.where("_row = component_id").select(F.col("_row.k").alias("_kept"), F.col("_row.h").alias("_kept_text")).distinct()
    stay = named.join(kept, (named[key] == kept["_kept"]) & (F.xxhash64(named[text]) == kept["_kept_text"]), "left_semi").dropDuplicates([key, text])
    return stay.unionByName(docs.where(F.col(key).isNull()))
