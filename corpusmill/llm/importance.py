"""Target-distribution importance resampling on hashed n-grams.

Words are runs of letters, digits and non-ASCII characters after A-Z are
lower-cased; features are all runs of 1 to ``order`` consecutive words, hashed
by CRC-32 into ``buckets``.  The whole corpus and the whole target are counted
per bucket; a bucket's gain is the smoothed log ratio of target to corpus in
thousandths.  A document's weight is the floored mean gain of its features, a
Gumbel number drawn from its id is added, and the highest scores are drawn: a
sample without replacement whose feature distribution follows the target.

Texts are worked on as Arrow arrays: ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode`` turn a slice of texts into word
indices; the indices, shifted against each other, are paired and encoded again,
so every distinct n-gram of a slice is hashed once (its CRC continues that of
its first words); ``take`` brings gains to positions and a segment reduction
adds them up per document.  A slice holds at most ``SLICE_BYTES`` of text; a
longer text is cut between words and its last words are carried over, so the
memory of a task does not grow with a text and no n-gram is lost.

Counts per bucket are summed in Spark (one row per task and bucket, then one
per bucket: ``buckets`` rows, a fixed size, reach the driver for the gains).
Ranks come from a range sort of the light (score, id) rows.

Defined results: a null, empty or wordless text has no features, weight 0 and
is not drawn; texts with fewer than ``min_words`` words have a score but no
rank; a row without an id has neither score nor rank and is not counted among
those drawn from; rows that repeat an id draw the same number and are ranked
one by one (ties: smaller id, then weight and number of features); an empty
target or corpus only has smoothed counts; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table, text_batches
from corpusmill.plans.indexing import dense_index

BUCKETS = 10_000
ORDER = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SLICE_BYTES = 4 << 20

# what is no word: ASCII other than digits and (lower-cased) letters
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_BYTES = re.compile(GAP.encode())


# ---- Arrow kernels over slices of texts -------------------------------------

def _pieces(texts: pa.Array, slice_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of (rows, texts) with about ``slice_bytes`` of text each; a
    longer text continues in the next slice, cut before a gap."""
    rows, parts, size = [], [], 0
    for row, value in enumerate(texts):
        data = value.as_buffer() if value.is_valid else None
        if data is None or not data.size:
            continue
        if data.size <= slice_bytes:
            rows.append(row), parts.append(value.as_py())
            size += data.size
        else:
            data, at = data.to_pybytes(), 0
            # ASCII letters of either case are words before they are lower-cased
            low = data.lower()
            while at < len(data):
                gap = _GAP_BYTES.search(low, at + slice_bytes - size) if len(data) - at > slice_bytes - size else None
                end = gap.start() if gap else len(data)
                rows.append(row), parts.append(data[at:end].decode())
                size += end - at
                at = end
                if at < len(data):
                    yield rows, parts
                    rows, parts, size = [], [], 0
        if size >= slice_bytes:
            yield rows, parts
            rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def _encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def features(texts: pa.Array, order: int, buckets: int, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, bucket)`` per slice and n-gram length: the row (not
    decreasing) and bucket of every n-gram of that many words."""
    carried_row, carried = -1, []  # the last words of a text cut by a slice
    for rows, parts in _pieces(texts, slice_bytes):
        if carried and rows[0] == carried_row:
            ghosts = len(carried)
            rows, parts = [carried_row, *rows], [" ".join(carried), *parts]
        else:
            ghosts = 0
        split = pc.split_pattern_regex(pc.ascii_lower(pa.array(parts, pa.large_string())), GAP)
        words = pc.list_flatten(split)
        sizes = np.repeat(np.array(rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        real = pc.not_equal(words, "")  # a text may begin or end with a gap
        words, owner = words.filter(real), sizes[real.to_numpy(zero_copy_only=False)]
        if not len(words):
            continue
        index, distinct = _encoded(words)
        spelled = [w.encode() for w in distinct.to_pylist()]
        last = int(owner[-1])
        if last == rows[-1]:
            carried_row, carried = last, words[max(0, int(np.searchsorted(owner, last)), len(words) - order + 1):].to_pylist() if order > 1 else []
        gram, crc = index, [zlib.crc32(w) for w in spelled]
        for length in range(1, order + 1):
            if length > 1:  # first words of a gram, and the word that follows them
                code, pairs = _encoded(pa.array(gram[:-1] * len(spelled) + index[length - 1:]))
                pairs = pairs.to_numpy()
                crc = [zlib.crc32(spelled[w], zlib.crc32(b" ", crc[g])) for g, w in
                       zip((pairs // len(spelled)).tolist(), (pairs % len(spelled)).tolist())]
                gram = code
            whole = owner[:len(gram)] == owner[length - 1:]
            whole[:max(0, ghosts - length + 1)] = False  # counted with the slice before
            bucket = pa.array(np.array(crc, np.int64) % buckets).take(pa.array(gram)).to_numpy()
            yield length, owner[:len(gram)][whole], bucket[whole]
            if len(gram) < 2:
                break


def bucket_counts(texts: DataFrame, text: str, order: int = ORDER, buckets: int = BUCKETS, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Features per bucket over all rows; ``buckets`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features(batch.column(0), order, buckets, slice_bytes):
                total += np.bincount(bucket, minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = text_batches(texts.select(F.col(text).alias("text"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of target to corpus per bucket, in thousandths, floored."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


# ---- per document -----------------------------------------------------------

def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", order: int = ORDER,
          slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(key, n_words, n_features, weight)`` of every row."""
    buckets, table = len(gain), pa.array(gain)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for length, rows, bucket in features(batch.column("text"), order, buckets, slice_bytes):
                if not len(rows):
                    continue
                values = table.take(pa.array(bucket)).to_numpy()
                starts = np.nonzero(np.diff(rows, prepend=-1))[0]
                own, n = rows[starts], np.diff(starts, append=len(rows))
                total[own] += np.add.reduceat(values, starts)
                grams[own] += n
                if length == 1:
                    words[own] += n
            weight = np.where(grams > 0, total // np.maximum(grams, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words), pa.array(grams), pa.array(weight)],
                                             ["key", "n_words", "n_features", "weight"])

    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)`` of every row; rank
    is 1, 2, 3... for the drawn ``percent`` of the rows with ``min_words``
    words, else null."""
    gain = gains(bucket_counts(docs, text, order, buckets, slice_bytes), bucket_counts(target, target_text, order, buckets, slice_bytes))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc").cast("string")).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    # written once: ranks and result read the same light rows
    scored = spill_table(weigh(docs, gain, key, text, order, slice_bytes).withColumnRenamed(key, "doc")
                         .withColumn("score", F.col("weight") + draw), "importance")
    eligible = scored.where((F.col("n_words") >= min_words) & F.col("doc").isNotNull())
    drawn = eligible.count() * percent // 100
    ordered = dense_index(eligible.select((-F.col("score")).alias("_order"), "doc", "weight", "n_features", "n_words", "score"),
                          ["_order", "doc", "weight", "n_features", "n_words"], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    rest = scored.where(F.coalesce(F.col("n_words") < min_words, F.lit(True)) | F.col("doc").isNull())
    columns = ["n_words", "n_features", "weight", "score"]
    return (ordered.select(F.col("doc").alias(key), *columns, rank.alias("rank"))
            .unionByName(rest.select(F.col("doc").alias(key), *columns, F.lit(None).cast("long").alias("rank"))))
