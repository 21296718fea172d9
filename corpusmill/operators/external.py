"""H1 through a caller's tokenizer.

A tokenizer is named by ``package.module:factory`` or given as a picklable
factory without arguments.  The factory is called once per Python worker and
returns a function from a list of texts to a list of token lists, ids (int) or
token texts (str).  Texts travel in Arrow batches and reach that function in
slices bounded in bytes, so neither a batch of long texts nor the token lists
of a whole partition stand in memory at once.

The result has the shape the built-in tokenizer gives: ``external_tokens``
feeds the vocabulary and the encoder (``tokens_col``), ``external_ids`` takes
the place of ``encode`` before labels, lengths and padding.

Defined results: a null text has no tokens; an answer of another length than
the slice fails the task.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.batches import MAX_LENGTH
from corpusmill.plans.scan import spread
from corpusmill.session import scratch_table

SLICE_BYTES = 1 << 20
_LOADED: dict = {}  # per worker process


def load_tokenizer(tokenizer: str | Callable) -> Callable[[list[str]], list[list]]:
    """The tokenizer's function; made at most once per process."""
    name = tokenizer if isinstance(tokenizer, str) else (tokenizer.__module__, tokenizer.__qualname__)
    if name not in _LOADED:
        if isinstance(tokenizer, str):
            module, _, attribute = tokenizer.partition(":")
            tokenizer = getattr(importlib.import_module(module), attribute)
        _LOADED[name] = tokenizer()
    return _LOADED[name]


def _slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _applied(df: DataFrame, tokenizer, text: str, key: str, max_length: int | None, out: str, item: T.DataType, arrow: pa.DataType, slice_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = load_tokenizer(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts, slice_bytes):
                found = split([t or "" for t in texts[a:b]])
                if len(found) != b - a:
                    raise ValueError(f"the tokenizer gave {len(found)} answers for {b - a} texts")
                rows = [list(x)[:max_length] if t else [] for x, t in zip(found, texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(arrow))], ["key", out])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField(out, T.ArrayType(item))])
    light = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return spread(light).mapInArrow(run, schema).withColumnRenamed("key", key)


def external_tokens(df: DataFrame, tokenizer: str | Callable, text: str = "text", key: str = "sample_id", out: str = "tokens",
                    slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, tokens array<string>), written once like ``tokenized``."""
    return scratch_table(_applied(df, tokenizer, text, key, None, out, T.StringType(), pa.string(), slice_bytes), "tokens")


def external_ids(df: DataFrame, tokenizer: str | Callable, text: str = "text", key: str = "sample_id", max_length: int = MAX_LENGTH,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(key, input_ids array<int>), cut on the right to ``max_length``."""
    return _applied(df, tokenizer, text, key, max_length, "input_ids", T.IntegerType(), pa.int32(), slice_bytes)
