"""Line dedup: lines that many documents share are dropped.

Every text is split at ``\\n`` and its lines are exploded with their position.
A line's key is the line without ASCII white space at both ends and with A-Z
lower-cased; two seeded 64-bit hashes stand for it (128 bits, so that an
accidental meeting is out of the question at any corpus size).  Keys are
counted by distinct documents: the map side keeps one (hash, document) row per
task, so a line that a third of all rows hold costs a task no more than its
documents, and the count itself is partial again.  The positions whose key is
frequent are gathered per distinct text and taken out of the split text, whose
remaining lines are joined in order.  Only hashes, ids and positions are
grouped; a text moves once, to meet its positions.  DataFrame functions only.

Defined results: a null or empty text is one empty line; keys of fewer than
``min_chars`` code points are never counted or dropped; rows that share a
document id count as one document, rows without an id count for nothing but
lose their frequent lines too; repeated rows come back as often as they were
given; a text that loses all lines is the empty string; there is no bound on a
text's length or its number of lines; an empty table gives an empty table;
extra columns are not read by ``frequent_lines`` and stay in ``drop_lines``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import small_side, spill_table

MIN_DOCUMENTS = 10
MIN_CHARS = 1
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The normalised line.  ``lower`` and A-Z lower-casing are the same on
    ASCII, where ``lower`` takes the cheap way through the bytes."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _digest(value: Column, name: str) -> list[Column]:
    """Two hashes with different seeds."""
    return [F.xxhash64(F.lit(1), value).alias(f"{name}1"), F.xxhash64(F.lit(2), value).alias(f"{name}2")]


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def line_hashes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``(doc, t1, t2, pos, h1, h2)``: every line that may be dropped."""
    lines = docs.select(F.col(key).alias("doc"), *_digest(_text(text), "t"), F.posexplode(F.split(_text(text), "\n")).alias("pos", "line"))
    keyed = lines.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select("doc", "t1", "t2", "pos", *_digest(F.col("k"), "h"))


def frequent_lines(hashes: DataFrame, min_documents: int) -> DataFrame:
    """``(h1, h2, n_documents)`` of the keys in at least ``min_documents``
    distinct documents."""
    held = hashes.where(F.col("doc").isNotNull()).select("h1", "h2", "doc").distinct()
    return (held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"))
            .where(F.col("n_documents") >= min_documents))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = MIN_DOCUMENTS,
               min_chars: int = MIN_CHARS, kept: str = "kept", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``kept`` (the text without its frequent lines; ``kept`` =
    ``text`` replaces it), ``n_lines`` (before dropping) and ``n_dropped``.
    Columns of ``docs`` with these names are replaced."""
    hashes = line_hashes(docs, key, text, min_chars)
    frequent = spill_table(frequent_lines(hashes, min_documents).select("h1", "h2"), "frequent-lines", few=True)
    # positions depend on the text alone, so equal texts share one row
    hit = hashes.join(small_side(frequent), ["h1", "h2"], "left_semi").select("t1", "t2", "pos").distinct()
    gone = spill_table(hit.groupBy("t1", "t2").agg(F.collect_list("pos").alias("gone")), "line-positions", few=True)
    others = [c for c in docs.columns if c not in (kept, n_lines, n_dropped)]
    rows = docs.select(F.struct(*[docs[c] for c in others]).alias("row"), _text(text).alias("text"), *_digest(_text(text), "t"))
    met = rows.join(gone, ["t1", "t2"], "left").select("row", "text", "gone", F.split("text", "\n").alias("lines"))
    # array_except is hash-based: linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda at: F.get("lines", at)), "\n"))
    return met.select("row.*", rest.alias(kept), F.size("lines").cast("long").alias(n_lines),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(n_dropped))
