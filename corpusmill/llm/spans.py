"""Span lists: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_columns(spans: Column, base: Sequence[str]) -> list[Column]:
    """``n_<kind>`` of the base kinds, ``base_sha256`` and ``spans``."""
    counts = [F.size(of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(span_text(of_kinds(spans, base)).cast("binary"), 256).alias("base_sha256")
    return [*counts, digest, span_text(spans).alias("spans")]
