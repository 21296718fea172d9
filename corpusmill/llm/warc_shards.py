"""Deterministic sharded WARC writer and reader.

Records are cut into key ranges of about ``shard_bytes`` payload each (exact
histogram, so the same input gives the same ranges), one range per task, sorted
by key.  A task writes one gzip member per record and rolls to a new file when
the compressed size passes ``roll_bytes``; record headers, lengths and digests
are made anew.  Files are written under temporary names that no two attempts
share; the manifest, committed by Spark's own writer, names the files of the
successful attempts, and only those are renamed to their final names.

Of records with equal payloads of at least ``revisit_bytes``, those with the
largest key are responses and the others revisit it.

Defined results: null payload is empty; null url has no target header; a null
key sorts first, is never the response others revisit, and is a response
unless its payload has one with a key; repeated rows are written as often as
they occur (with the same record id) and rows of one key stay in one shard; an empty table gives no files; only the
named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table

SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
REVISIT_BYTES = 1000
DATE = "2000-01-01T00:00:00Z"
BUCKETS = 4096

_MASK = (1 << 64) - 1
_SPACE, _SPACE_NULL = 0x6F6E_6570_6167_4000, 0x6F6E_6570_6167_4001
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("temporary", T.StringType()), T.StructField("records", T.LongType()),
    T.StructField("file_bytes", T.LongType()), T.StructField("sha256", T.StringType())])


# ---- key ranges ------------------------------------------------------------

def key_ranges(light: DataFrame, shard_bytes: int) -> list[int]:
    """Lower bounds of the shards after the first, from an exact histogram of
    bytes by key (``key``, ``size``).  A bucket above the target is counted
    again with finer buckets.  The list has at most one bound per
    ``shard_bytes`` / 2 of payload plus the buckets of one level."""
    ends = light.agg(F.min("key"), F.max("key")).first()
    if ends[0] is None:
        return []
    cells = _histogram(light, [(int(ends[0]), int(ends[1]) + 1)])
    while True:
        heavy = [(a, b) for a, b, n in cells if n > shard_bytes and b - a > 1]
        if not heavy:
            break
        cells = sorted([c for c in cells if not (c[2] > shard_bytes and c[1] - c[0] > 1)] + _histogram(light, heavy))
    bounds, filled = [], 0
    for a, _, n in cells:
        if filled and filled + n > shard_bytes:
            bounds.append(a)
            filled = 0
        filled += n
    return bounds


def _histogram(light: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(from, to, bytes) of the non-empty cells, each span in up to BUCKETS / #spans."""
    per = max(2, BUCKETS // len(spans))
    frame = pd.DataFrame([(a, b, -(-(b - a) // per)) for a, b in spans], columns=["lo", "hi", "width"]).sort_values("lo")
    lows, highs, widths = (frame[c].to_numpy(dtype=object) for c in ("lo", "hi", "width"))
    starts = np.array([int(x) for x in lows], dtype=np.int64)

    @F.pandas_udf("long")
    def cell(keys: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, keys.to_numpy(np.int64), side="right") - 1
        out = [int(lows[i]) + (k - int(lows[i])) // int(widths[i]) * int(widths[i]) if i >= 0 and k < int(highs[i]) else None
               for i, k in zip(at, keys.tolist())]
        return pd.Series(out, dtype="Int64")

    counted = (light.where(F.col("key").isNotNull()).groupBy(cell("key").alias("cell")).agg(F.sum("size").alias("n"))
               .where(F.col("cell").isNotNull()).collect())  # at most BUCKETS or two a span
    out = []
    for r in sorted(counted, key=lambda r: r["cell"]):
        i = int(np.searchsorted(starts, r["cell"], side="right")) - 1
        out.append((r["cell"], min(r["cell"] + int(widths[i]), int(highs[i])), int(r["n"])))
    return out


# ---- records ---------------------------------------------------------------

def record_id(key: int | None) -> str:
    value = (_SPACE_NULL << 64) if key is None else (_SPACE << 64) | (key & _MASK)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def key_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = value & _MASK
    return None if value >> 64 == _SPACE_NULL else low - (1 << 64) if low >> 63 else low


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe_uri(uri: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def make_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _safe_uri(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload))]
    if revisit:
        return make_record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))], http)
    return make_record("response", headers, http + payload)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip file, member by member."""
    pending = b""
    while True:
        pending = pending or stream.read(1 << 20)
        if not pending:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            parts.append(inflate.decompress(pending))
            pending = inflate.unused_data if inflate.eof else stream.read(1 << 20)
            if not pending and not inflate.eof:
                raise ValueError("a record is cut short")
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[:int(headers["Content-Length"])]
        if _digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
        yield headers, block


# ---- writer ----------------------------------------------------------------

class _Shard:
    """The files of one shard, one open at a time."""

    def __init__(self, out: str, shard: int, roll_bytes: int, level: int, date: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(out)
        self.shard, self.roll_bytes, self.level, self.date = shard, roll_bytes, level, date
        self.part, self.file, self.done = 0, None, []

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.file = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.hash, self.size, self.records = hashlib.sha256(), 0, 0
        info = f"software: sharded writer\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        unique = uuid.uuid5(uuid.NAMESPACE_URL, self.name)
        self._put(make_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{unique}>"), ("WARC-Date", self.date),
                                           ("Content-Type", "application/warc-fields")], info))

    def _put(self, record: bytes) -> None:
        gz = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # no time stamp in the header
        member = gz.compress(record) + gz.flush()
        self.file.write(member)
        self.hash.update(member)
        self.size += len(member)

    def add(self, record: bytes) -> None:
        if self.file is None:
            self._open()
        self._put(record)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.shard, self.part, self.name, self.temporary, self.records, self.size, self.hash.hexdigest()))
            self.part, self.file = self.part + 1, None


def _writer(out: str, roll_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files = None, None
        at, refers = None, {}  # of the current key: payload digest -> the key it revisits
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c) for c in ("shard", "key", "digest", "url", "payload", "refers_to"))):
                number, key, digest, url, payload, refers_to = (x.as_py() for x in row)
                if number != shard:
                    if files:
                        files.close()
                        done += files.done
                    shard, files, at, refers = number, _Shard(out, number, roll_bytes, level, date), None, {}
                if key != at:
                    at, refers = key, {}
                if payload is None:  # a mark: it comes before the rows of its key
                    refers[digest] = refers_to
                else:
                    files.add(page_record(key, url, payload, refers.get(digest), digest in refers, date))
            if files:
                done += files.done
                files.done = []
            if done:
                yield _manifest_batch(done)
        if files:
            files.close()
            if files.done:
                yield _manifest_batch(files.done)

    return run


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], MANIFEST.names)


def write_warc(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html",
               shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES,
               date: str = DATE, level: int = 6) -> DataFrame:
    """Write the archive under ``out`` (a folder that all executors reach) and
    return its manifest, which is also kept in ``out/_manifest``."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    light = spill_table(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    repeated = spill_table(
        light.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to"), "warc-repeated")
    marks = (light.where(F.col("size") >= revisit_bytes).join(repeated, "digest")
             .where(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "digest", "refers_to").distinct())

    bounds = np.array(key_ranges(light, shard_bytes), dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        at = np.searchsorted(bounds, keys.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(known, at, 0).astype(np.int32))

    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        marks.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to"))
    placed = both.withColumn("shard", shard_of("key"))
    ordered = (placed.repartitionById(len(bounds) + 1, F.col("shard"))
               .sortWithinPartitions("shard", F.asc_nulls_first("key"), F.col("payload").isNotNull(), "digest", F.asc_nulls_first("url")))
    written = ordered.select("shard", "key", "digest", "url", "payload", "refers_to").mapInArrow(_writer(out, roll_bytes, level, date), MANIFEST)
    written.write.mode("errorifexists").parquet(f"{out}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    _publish(manifest, out)
    return manifest


def _publish(manifest: DataFrame, out: str) -> None:
    """Rename the committed files; done again after a failure it goes on where
    it stopped.  What failed attempts left goes with the temporary folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for temporary, name, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "file_bytes"))):
                final = fs.get_file_info(f"{root}/{name}")
                if final.type != pafs.FileType.File or final.size != size:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch.select(["name"])

    manifest.select("temporary", "name", "file_bytes").mapInArrow(run, "name string").agg(F.count("name")).collect()
    fs, root = pafs.FileSystem.from_uri(out)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")


# ---- reader ----------------------------------------------------------------

READ = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The page records of a committed archive: digests are checked against
    the blocks and payloads, lengths and digests of revisits are those of the
    full payload.  Files are streamed record by record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in read_records(stream):
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(_page(headers, block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (
                        pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], READ.names)

    names = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest").select("name")
    n = names.count()  # files, not records
    return names.repartition(max(1, min(n, 10_000))).mapInArrow(run, READ)


def _page(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b": ")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    digest = headers["WARC-Payload-Digest"]
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']}")
    return (key_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), length,
            base64.b32decode(digest.removeprefix("sha1:")).hex(), headers["WARC-Type"],
            key_of(headers["WARC-Refers-To"]) if revisit else None)
