"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively down to leaves; every node holds the exact
encoding of its own span, and two neighbours are joined by encoding again a
window around their border.  Two facts bound the window:

* A position whose left character is no white space and whose right character
  is white space (or that lies between two different ASCII classes) ends a
  match of the splitting pattern whatever stands around it, so tokens beyond
  such a position cannot change.  The window grows to the next such position
  on either side.
* Inside one long match, a token sequence is the encoding of its bytes exactly
  if every neighbouring pair of tokens is the encoding of its own bytes
  (every vocabulary entry being reachable by merges).  The window grows until
  the pairs at both of its ends hold.

Decoding concatenates the bytes of the halves up the same tree.

Defined results: null text is empty and has no ids; empty text likewise;
special-token strings are ordinary text; repeated rows are encoded row by row;
an empty table gives an empty table.  Only the named key and text columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import text_batches

LEAF_CHARS = 2048
LEAF_BYTES = 1024
SLICE_BYTES = 4 << 20  # texts handled at a time in a task

WHITE = " \t\n\r\x0b\x0c"


def _ascii_class(c: str) -> str:
    if c.isspace():
        return "w"
    if not c.isascii():
        return "?"
    return "a" if c.isalpha() else "d" if c.isdigit() else "s"


# pairs of classes between which every match of the pattern ends
_ENDS = {("a", "d"), ("a", "s"), ("d", "a"), ("d", "s"), ("s", "d")}


def is_boundary(left: str, right: str) -> bool:
    """True if a match ends between these two characters in any context."""
    if right in WHITE:
        return not left.isspace()
    return (_ascii_class(left), _ascii_class(right)) in _ENDS


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_bytes: int = LEAF_BYTES) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.core = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {i: b for b, i in ranks.items()}
        self.pair: dict[tuple[int, int], bool] = {}

    # ---- text level: matches of the pattern --------------------------------

    def encode(self, text: str) -> list[int]:
        return self._span(text, 0, len(text))

    def _span(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self.core.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        left, right = self._span(text, a, mid), self._span(text, mid, b)
        if is_boundary(text[mid - 1], text[mid]):
            return left + right
        lo = next((p for p in range(mid - 1, a, -1) if is_boundary(text[p - 1], text[p])), a)
        hi = next((p for p in range(mid + 1, b) if is_boundary(text[p - 1], text[p])), b)
        window = text[lo:hi]
        if len(window) <= self.leaf_chars:
            middle = self.core.encode_ordinary(window)
        else:
            middle = [i for m in self.pieces.finditer(window) for i in self.encode_piece(m[0].encode())]
        keep = self._cut(left, len(text[lo:mid].encode()), from_end=True)
        drop = self._cut(right, len(text[mid:hi].encode()), from_end=False)
        return left[:keep] + middle + right[drop:]

    def _cut(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """Index that separates the tokens covering ``n_bytes`` at one end."""
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.token[ids[-1 - k] if from_end else ids[k]])
            k += 1
        if n_bytes:
            raise AssertionError("a token crosses a proven boundary")
        return len(ids) - k if from_end else k

    # ---- byte level: merges inside one match -------------------------------

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._merge(data)

    def _merge(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.core._encode_single_piece(data)
        mid = len(data) // 2
        return self._join(self._merge(data[:mid]), self._merge(data[mid:]))

    def _holds(self, x: int, y: int) -> bool:
        known = self.pair.get((x, y))
        if known is None:
            if len(self.pair) > 200_000:
                self.pair.clear()
            known = self.pair[x, y] = self.core._encode_single_piece(self.token[x] + self.token[y]) == [x, y]
        return known

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if self._holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self.core._encode_single_piece(b"".join(self.token[t] for t in left[-i:] + right[:j]))
            left_holds = i == len(left) or self._holds(left[-i - 1], middle[0])
            right_holds = j == len(right) or self._holds(middle[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + middle + right[j:]
            i, j = i * (1 if left_holds else 2), j * (1 if right_holds else 2)

    # ---- decoding ----------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return self.core.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as fh:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, fh)}


@lru_cache(maxsize=2)  # once per Python worker
def _coder(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(load_ranks(path), pattern)


def _slices(batch: pa.RecordBatch, column: str, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``n_bytes`` each, one row at least."""
    rows = max(1, min(batch.num_rows, n_bytes * max(1, batch.num_rows) // max(1, batch.column(column).nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                     ids: str = "ids") -> DataFrame:
    """``(key, ids array<int>)`` of every row.  ``path``: the rank file, which
    every executor must have; it is read once per Python worker."""
    key_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for part in _slices(batch, "text"):
                out = [coder.encode(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "ids"])

    schema = T.StructType([T.StructField("key", key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).select(F.col("key").alias(key), F.col("ids").alias(ids))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Replace the column ``ids`` by the decoded bytes ``data`` (null ids: null)."""
    others = [c for c in encoded.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for part in _slices(batch, ids):
                out = [None if x is None else coder.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(out, pa.binary())], others + [data])

    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(data, T.BinaryType())])
    return text_batches(encoded).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, data)``: both ways in one pass, so that a task has one
    Python worker and the ids cross once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = [coder.encode(t) if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(ids, pa.list_(pa.int32())),
                                                  pa.array([coder.decode(x) for x in ids], pa.binary())], ["key", "ids", "data"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("data", T.BinaryType())])
    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode the ids: key, ids, n_tokens, and the ids (joined by
    commas) and the decoded bytes as SHA-256 digests."""
    return encode_and_decode(docs, path, pattern, key, text).select(
        key, "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"))
