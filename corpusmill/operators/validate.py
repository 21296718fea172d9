"""Validation, routing and formatting of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.chat import DEFAULT_SYSTEM, render_chat
from corpusmill.functions.text import is_blank, strip
from corpusmill.functions.think import THINK_CLOSE, THINK_OPEN

# Columns a question/solution/answer sample must carry.
REQUIRED_QA = ("question", "solution", "answer")


def missing_columns(df: DataFrame, required=REQUIRED_QA) -> list[str]:
    """B1 (schema form): required names absent from the schema.  Processing
    continues; the caller decides whether to warn."""
    return [c for c in required if c not in df.columns]


def missing_fields(df: DataFrame, required=REQUIRED_QA) -> Column:
    """B1 (per-row form): required fields that are absent (null) in the row,
    in required order."""
    return F.array_compact(F.array(*[
        (F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c)) for c in required
    ]))


def validate_required(df: DataFrame, required=None, key: str = "sample_id") -> DataFrame:
    """B2: one row (valid, n_rows, first_row, first_field).

    Invalid when the table is empty, or when a row lacks a required field;
    the first such row by ``key`` is reported with its first missing field in
    required order.  Without a required list only emptiness is tested."""
    if required:
        missing = missing_fields(df, required)
        bad = F.when(F.size(missing) > 0, F.struct(F.col(key).alias("row"), missing[0].alias("field")))
    else:
        bad = F.lit(None).cast("struct<row:bigint,field:string>")
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(bad).alias("_first"))
    return agg.select(
        ((F.col("n_rows") > 0) & F.col("_first").isNull()).alias("valid"),
        "n_rows",
        F.col("_first.row").cast("bigint").alias("first_row"),
        F.col("_first.field").alias("first_field"),
    )


def _present(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def route_format(df: DataFrame) -> DataFrame:
    """``kind`` by key presence, first match wins: qa, text, io, unknown."""
    kind = (F.when(_present(df, "solution") & _present(df, "answer"), F.lit("qa"))
            .when(_present(df, "text"), F.lit("text"))
            .when(_present(df, "input") & _present(df, "output"), F.lit("io"))
            .otherwise(F.lit("unknown")))
    return df.withColumn("kind", kind)


def drop_incomplete_qa(df: DataFrame) -> DataFrame:
    """A qa row with a blank question, solution or answer is dropped; it
    never falls through to another kind.  Unknown rows are dropped as well."""
    return df.filter(drop_reason(df).isNull())


def drop_reason(df: DataFrame) -> Column:
    """Why B4 drops a routed row: ``incomplete`` or ``unknown``; null: it stays."""
    blank = is_blank(_opt(df, "question")) | is_blank(_opt(df, "solution")) | is_blank(_opt(df, "answer"))
    return F.when(F.col("kind") == "unknown", F.lit("unknown")).when((F.col("kind") == "qa") & blank, F.lit("incomplete"))


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def format_qa(df: DataFrame, start: str = THINK_OPEN, end: str = THINK_CLOSE,
              key: str = "sample_id") -> DataFrame:
    """Qa rows become (messages, text) with the solution wrapped in think
    tags; text and io rows pass with their own fields.  Other columns drop."""
    is_qa = F.col("kind") == "qa"
    response = F.concat(F.lit(start + "\n\n"), strip("solution"), F.lit("\n\n" + end + "\n\n"), strip("answer"))
    messages = F.array(
        F.struct(F.lit("user").alias("role"), strip("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), response.alias("content")),
    )
    return df.select(
        key, "kind",
        F.when(is_qa, messages).alias("messages"),
        F.when(is_qa, response).otherwise(_opt(df, "text")).alias("text"),
        F.when(~is_qa, _opt(df, "input")).alias("input"),
        F.when(~is_qa, _opt(df, "output")).alias("output"),
    )


def effective_text(df: DataFrame, default_system: str = DEFAULT_SYSTEM) -> Column:
    """Rendered chat when ``messages`` exists, else ``text``, else ''."""
    rendered = F.when(F.col("messages").isNotNull(), render_chat("messages", default_system)) \
        if "messages" in df.columns else F.lit(None).cast("string")
    return F.coalesce(rendered, _opt(df, "text"), F.lit(""))


def rewritable(col: str = "solution") -> Column:
    """B7 predicate: the solution is present and not blank."""
    return ~is_blank(col)


def split_rewritable(df: DataFrame, col: str = "solution") -> tuple[DataFrame, DataFrame]:
    """(rows to rewrite, rows kept unchanged)."""
    return df.filter(rewritable(col)), df.filter(~rewritable(col))
