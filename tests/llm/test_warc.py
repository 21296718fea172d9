"""WARC writer: round trip, determinism, rolling, revisits."""

import hashlib

import pytest
from pyarrow import fs as pafs

from corpusmill.llm import warc_shards as warc
from corpusmill.session import scratch_path

LONG = "é<p>" * 400
ROWS = [(i, f"http://h/{i}", "page %d " % i * 60) for i in range(200)] + [
    (300, "http://a", LONG), (310, "http://b", LONG), (305, None, LONG), (-7, "http://c\r\nX: y z", None), (8_000_000_000, "u", ""),
    (311, "u", "short"), (312, "u", "short"), (None, "n", LONG), (None, "n", "alone" * 300), (310, "http://b", LONG)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, shard int, key string").repartition(3)


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if h == html and k is not None] if len(data) >= 1000 else []
        to = max(same) if same and max(same) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def archive(spark, out):
    found = warc.read_warc(spark, out).collect()
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


def test_round_trip_is_whole_and_deterministic(spark):
    outs = [scratch_path(spark, "warc"), scratch_path(spark, "warc")]
    manifests = [warc.write_warc(frame(spark), out, shard_bytes=20_000, roll_bytes=2_000).orderBy("name").collect() for out in outs]
    assert archive(spark, outs[0]) == expected(ROWS)
    assert [(m.name, m.records, m.sha256) for m in manifests[0]] == [(m.name, m.records, m.sha256) for m in manifests[1]]
    assert len({m.shard for m in manifests[0]}) > 3 and any(m.part > 0 for m in manifests[0])
    fs, root = pafs.FileSystem.from_uri(outs[0])
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file)
    assert names == [m.name for m in manifests[0]]  # nothing temporary is left
    for m in manifests[0]:
        with fs.open_input_stream(f"{root}/{m.name}", compression=None) as stream:
            assert hashlib.sha256(stream.read()).hexdigest() == m.sha256
    urls = {r.key: r.url for r in warc.read_warc(spark, outs[0]).collect()}
    assert urls[-7] == "http://c%0D%0AX:%20y%20z" and urls[305] is None


def test_publish_goes_on_after_a_failure(spark):
    out = scratch_path(spark, "warc")
    manifest = warc.write_warc(frame(spark), out)
    warc._publish(manifest, out)  # all files have their names already
    assert archive(spark, out) == expected(ROWS)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        warc.write_warc(frame(spark), out)


def test_empty_table(spark):
    out = scratch_path(spark, "warc")
    assert warc.write_warc(frame(spark).limit(0), out).collect() == []
    assert warc.read_warc(spark, out).collect() == []


def test_record_ids():
    for k in (None, 0, -1, 5, -(1 << 63), (1 << 63) - 1):
        assert warc.key_of(warc.record_id(k)) == k
