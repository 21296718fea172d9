"""Shared job helpers."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Read the job input: ``jsonl`` (strict, declared schema) or any Spark
    format (parquet by default)."""
    if fmt == "jsonl":
        from corpusmill.sources.jsonl import read_jsonl
        if not schema:
            raise ValueError("a JSONL input needs --schema")
        return read_jsonl(spark, path, schema, mode="strict")
    return spark.read.format(fmt).load(path)


def load_object(spec: str):
    """``package.module:name`` -> object (a transformer factory, say)."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)
