"""Text constants and Column helpers shared by every operator.

Python's ``str.strip()`` and the ``\\s`` class of Python's ``re`` remove a set
of 29 code points.  Spark ``trim`` removes spaces only and Java's ``\\s`` is
ASCII, so every strip and every whitespace class here is spelled out.  The
``\\x{...}`` escape form is understood by both Java regex and RE2, so the same
pattern text serves Spark and the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() and re's \s treat as
# whitespace, in code point order.
WS_CODEPOINTS = (
    0x0009, 0x000A, 0x000B, 0x000C, 0x000D, 0x001C, 0x001D, 0x001E, 0x001F,
    0x0020, 0x0085, 0x00A0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)
WS = "".join(chr(cp) for cp in WS_CODEPOINTS)


def _class_body(codepoints) -> str:
    """Character-class body with consecutive code points merged into ranges
    (Java evaluates a few ranges faster than many single characters)."""
    parts, run = [], []
    for cp in sorted(codepoints):
        if run and cp == run[-1] + 1:
            run.append(cp)
            continue
        if run:
            parts.append(run)
        run = [cp]
    if run:
        parts.append(run)
    return "".join("\\x{%X}" % r[0] if len(r) == 1 else "\\x{%X}-\\x{%X}" % (r[0], r[-1]) for r in parts)


WS_CLASS_BODY = _class_body(WS_CODEPOINTS)
WS_CLASS = "[" + WS_CLASS_BODY + "]"

# sentence boundary: a run of terminators followed by whitespace
SENTENCE_SPLIT = "[.!?]+" + WS_CLASS + "+"

# word / non-word runs used by the lexicon rewriter; no \b (differs by engine)
WORD_RUNS = "[A-Za-z]+|[^A-Za-z]+"

_REGEX_META = set("\\^$.|?*+()[]{}")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` as a Column expression."""
    return F.btrim(col_of(c), F.lit(WS))


def is_blank(c) -> Column:
    """True when the value is null, empty or whitespace only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def regex_escape(token: str) -> str:
    """Escape a literal for Java regex and RE2 alike."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in token)


def alternation(tokens) -> str:
    """One pattern matching any of the literal tokens, longest first."""
    ordered = sorted(set(tokens), key=lambda t: (-len(t), t))
    return "|".join(regex_escape(t) for t in ordered)


def split_sentences(c) -> Column:
    """Split the stripped text on terminator runs followed by whitespace,
    strip every piece and drop blank ones."""
    pieces = F.split(strip(c), SENTENCE_SPLIT)
    return F.filter(F.transform(pieces, strip), lambda x: F.length(x) > 0)


def count_literal(c, token: str) -> Column:
    """Non-overlapping occurrences of a literal (Python ``str.count``)."""
    c = col_of(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("bigint")


# ---- SQL text for the DuckDB oracle -------------------------------------

def sql_ws() -> str:
    return "(" + " || ".join(f"chr({cp})" for cp in WS_CODEPOINTS) + ")"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {sql_ws()})"


def sql_literal(text: str) -> str:
    """A DuckDB string literal (control characters via chr())."""
    parts, buf = [], []
    for ch in text:
        if ord(ch) < 32 or ch == "'":
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append("''''" if ch == "'" else f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(parts) + ")"
