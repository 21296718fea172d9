"""Importance resampling against a plain restatement; edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import catalog, importance

from ..conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def grams(text, order=2):
    ws = words(text)
    return [" ".join(ws[i:i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def plain(docs, target, buckets=10_000, min_words=20, percent=25):
    s = Counter(bucket(g, buckets) for _, t in docs for g in grams(t))
    t = Counter(bucket(g, buckets) for x in target for g in grams(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for d, text in docs:
        gs = [bucket(g, buckets) for g in grams(text)]
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in gs]
        weight = sum(gain) // len(gain) if gain else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(gs), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[0] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for rank, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


TEXT = st.text(alphabet=st.sampled_from("abAB12 .,-éÉ漢\x00\n"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 4), st.integers(1, 30))
def test_features_of_slices_equal_brute_force(texts, order, slice_bytes):
    found = Counter()
    for _, rows, buckets in importance.features(pa.array(texts, pa.string()), order, 97, slice_bytes):
        found.update(zip(rows.tolist(), buckets.tolist()))
    assert found == Counter((i, bucket(g, 97)) for i, t in enumerate(texts) for g in grams(t, order))


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_edge_rows_equal_restatement(spark):
    long = " ".join(f"Word{i % 900}, teil-{i % 77}" for i in range(20_000))
    texts = ["The quick brown fox. " * 8, None, "", " .,;! ", "x " * 20, "x " * 19, "漢字 " * 25, long, "A1 b2 " * 30, "x " * 20]
    docs = [(i, t) for i, t in enumerate(texts * 4)] + [(None, "no id " * 20), (3, "x " * 20), (3, "x " * 20), (3, "x " * 21)]
    target = ["the quick fox", None, "teil 3 word5", ""]
    frame = spark.createDataFrame([(*r, 7, "rank") for r in docs], "doc_id long, text string, rank int, bucket string")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    want = plain(docs, target)
    assert rows_of(importance.resample(frame, goal)) == want
    assert rows_of(importance.resample(frame, goal, slice_bytes=1000)) == want
    assert rows_of(importance.resample(frame, goal.limit(0))) == plain(docs, [])
    assert importance.resample(frame.limit(0), goal).count() == 0


def test_registered_query_equals_restatement(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    assert rows_of(catalog.QUERIES["op12_importance_resampling"](spark, SF_SMALL)) == plain(docs, target)
