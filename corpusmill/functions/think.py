"""Think-tag Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col_of, count_literal, regex_escape, strip

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"


def span_pattern(open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE) -> str:
    """Shortest match between the tags, crossing newlines."""
    return "(?s)" + regex_escape(open_tag) + "(.*?)" + regex_escape(close_tag)


def think_counts(c, open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE):
    """non-overlapping counts of the open and close tags."""
    return count_literal(c, open_tag), count_literal(c, close_tag)


def think_balanced(c, open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE) -> Column:
    """equal counts; no tags is balanced; order is not checked."""
    opens, closes = think_counts(c, open_tag, close_tag)
    return opens == closes


def think_spans(c, open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE) -> Column:
    """F3 (array form): raw content of every shortest-match span."""
    return F.regexp_extract_all(col_of(c), F.lit(span_pattern(open_tag, close_tag)), F.lit(1))


def span_lengths(spans: Column) -> Column:
    """Length of every span after strip."""
    return F.transform(spans, lambda x: F.length(strip(x)).cast("bigint"))


def split_response(c, open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE):
    """(reasoning, answer).

    reasoning is the first span, stripped (null when there is none); answer is
    the text after the first close tag, stripped (the whole text, stripped,
    when there is no close tag)."""
    c = col_of(c)
    first = F.regexp_extract(c, span_pattern(open_tag, close_tag), 1)
    has_span = F.regexp_like(c, F.lit(span_pattern(open_tag, close_tag)))
    reasoning = F.when(has_span, strip(first))
    pos = F.instr(c, close_tag)
    answer = F.when(pos > 0, strip(F.substr(c, pos + F.lit(len(close_tag))))).otherwise(strip(c))
    return reasoning, answer


def close_think(c, open_tag: str = THINK_OPEN, close_tag: str = THINK_CLOSE):
    """F8: append the missing close tags; flag texts with surplus closes."""
    c = col_of(c)
    opens, closes = think_counts(c, open_tag, close_tag)
    closed = F.concat(c, F.repeat(F.lit(close_tag), F.greatest(opens - closes, F.lit(0)).cast("int")))
    return closed, closes > opens
