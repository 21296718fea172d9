"""Deterministic lexicon rewriter and term usage.

A lexicon is a table (term, target, hybrid), one row per term.  A term starts
and ends with a letter and may hold spaces, hyphens or other characters in
between.  Its *chosen form* is the shortest of term, target and hybrid; a tie
keeps the term, then the target.

Matching rule, the same in all forms: from left to right, at the start of a
letter run, the longest term that equals the text there and ends with its
letter run is taken, and the search goes on behind it.  Every term takes part;
one whose chosen form is the term itself stays as it is.  Letter runs use
explicit classes (``[A-Za-z]+``), never ``\\b``, so Java and RE2 agree.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import WORD_RUNS, alternation, col_of
from corpusmill.plans.sizes import broadcast_if_small
from corpusmill.session import scratch_table

# a term may span at most so many letter and non-letter runs
MAX_TERM_RUNS = 63
# a lexicon that is copied into every task may have at most so many terms
MAX_MAPPING = 100_000


def chosen_form(term: Column, target: Column, hybrid: Column) -> Column:
    lt, lg = F.length(term), F.length(target)
    lh = F.coalesce(F.length(hybrid), F.lit(2 ** 31 - 1))
    return (F.when((lt <= F.coalesce(lg, F.lit(2 ** 31 - 1))) & (lt <= lh), term)
            .when(lg <= lh, target)
            .otherwise(hybrid))


def with_choice(lexicon: DataFrame) -> DataFrame:
    """(term, target, hybrid, chosen); a repeated term, or one that does not
    start and end with a letter, fails the job."""
    one = lexicon.groupBy("term").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("target", "hybrid")).alias("_f"))
    n_runs = F.size(F.regexp_extract_all("term", F.lit(WORD_RUNS), F.lit(0)))
    sound = F.regexp_like("term", F.lit("^[A-Za-z]")) & F.regexp_like("term", F.lit("[A-Za-z]$")) & (n_runs <= MAX_TERM_RUNS)
    term = (F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("lexicon term repeated: "), "term")))
            .when(~F.coalesce(sound, F.lit(False)), F.raise_error(F.concat(F.lit("not a lexicon term: "), F.coalesce("term", F.lit("null")))))
            .otherwise(F.col("term")))
    out = one.select(term.alias("term"), F.col("_f.target").alias("target"), F.col("_f.hybrid").alias("hybrid"))
    return out.withColumn("chosen", chosen_form(F.col("term"), F.col("target"), F.col("hybrid")))


def collect_mapping(lexicon: DataFrame, limit: int = MAX_MAPPING) -> dict[str, str]:
    """{term: chosen form} for the forms that hold the lexicon themselves.  A
    larger lexicon is refused; ``lexicon_rewrite_table`` takes any size."""
    n = lexicon.count()
    if n > limit:
        raise ValueError(f"{n} terms do not fit a mapping of {limit}; use lexicon_rewrite_table")
    return {r["term"]: r["chosen"] for r in with_choice(lexicon).select("term", "chosen").collect()}


def lexicon_rewrite(c, mapping: dict[str, str]) -> Column:
    """D9, Column form for a small lexicon: the text is cut into terms, other
    letter runs and non-letter runs, terms are swapped, the pieces joined."""
    if not mapping:
        return col_of(c)
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    pieces = F.regexp_extract_all(col_of(c), F.lit(f"(?<![A-Za-z])(?:{alternation(mapping)})(?![A-Za-z])|{WORD_RUNS}"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(m, x), x)), "")


def _runs(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(WORD_RUNS), F.lit(0))


def _candidates(df: DataFrame, text: str, key: str, lengths: list[int]) -> DataFrame:
    """(key, at, runs, found): what stands at every letter run, cut to each
    length that a term has."""
    rows = df.select(key, _runs(text).alias("_r"))
    starts = rows.select(key, "_r", F.posexplode("_r").alias("at", "_run")).filter(F.regexp_like("_run", F.lit("^[A-Za-z]")))
    here = F.array(*[F.struct(F.lit(n).alias("runs"), (F.col("_run") if n == 1 else F.array_join(F.slice("_r", F.col("at") + 1, n), "")).alias("found"))
                     for n in lengths])
    return starts.select(key, "at", F.inline(here))


def _taken(df: DataFrame, text: str, key: str, terms: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, taken array<struct<at, runs, term, chosen>>): the matches of the
    rule, in text order, of every row that has one."""
    hits = _candidates(df, text, key, lengths).join(broadcast_if_small(terms), F.col("found") == F.col("term"))
    hits = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("runs")).alias("less"), "term", "chosen"))).alias("_h"))
    item = "struct<at:int,runs:int,term:string,chosen:string>"
    one = lambda h: F.struct(h["at"].alias("at"), (-h["less"]).alias("runs"), h["term"].alias("term"), h["chosen"].alias("chosen"))
    if lengths == [1]:  # single words never overlap
        return hits.select(key, F.transform("_h", one).alias("taken"))
    none = F.array().cast(f"array<{item}>")
    fold = F.aggregate(
        "_h", F.struct(F.lit(0).alias("free"), none.alias("taken")),
        lambda s, h: F.when(h["at"] >= s["free"], F.struct((h["at"] - h["less"]).alias("free"), F.concat(s["taken"], F.array(one(h))).alias("taken")))
        .otherwise(s))
    return hits.select(key, fold["taken"].alias("taken"))


def _prepared(lexicon: DataFrame) -> tuple[DataFrame, list[int]]:
    """The checked lexicon, written once, and the distinct lengths of its terms
    in runs (at most MAX_TERM_RUNS numbers)."""
    lex = scratch_table(with_choice(lexicon).withColumn("runs", F.size(_runs("term"))), "lexicon")
    return lex, sorted(r["runs"] for r in lex.select("runs").distinct().collect())


def lexicon_rewrite_table(df: DataFrame, text: str, key: str, lexicon: DataFrame,
                          out: str = "rewritten") -> DataFrame:
    """D9 over a table with a lexicon of any size; ``key`` must be unique.

    What stands at each letter run is joined with the terms; the matches that
    the rule takes return to their row, which is rebuilt from the stretches
    between them.  Null text stays null."""
    lex, lengths = _prepared(lexicon)
    if not lengths:
        return df.withColumn(out, F.col(text))
    taken = _taken(df, text, key, lex.select("term", "chosen"), lengths).withColumnRenamed(key, "_key")
    both = df.join(taken, F.col(key) == F.col("_key"), "left").withColumn("_r", _runs(text))
    end = lambda m: m["at"] + m["runs"]
    before = lambda j: F.when(j > 0, end(F.element_at("taken", j))).otherwise(F.lit(0))
    pieces = F.transform("taken", lambda m, j: F.concat(
        F.array_join(F.slice("_r", before(j) + 1, m["at"] - before(j)), ""), m["chosen"]))
    last = end(F.element_at("taken", -1))
    tail = F.array_join(F.slice("_r", last + 1, F.greatest(F.size("_r") - last, F.lit(0))), "")
    new = F.when(F.col("taken").isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))
    return both.withColumn(out, new).drop("_key", "taken", "_r")


def term_usage(df: DataFrame, text: str, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per lexicon term, how often the rule takes it in the corpus, its
    chosen form, and the characters the choice saves.  Counts are partial per
    task before they are shuffled by term."""
    lex, lengths = _prepared(lexicon)
    taken = _taken(df, text, key, lex.select("term", "chosen"), lengths or [1])
    counts = taken.select(F.explode("taken.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return lex.join(counts, "term", "left").select(
        "term", "chosen", n.alias("occurrences"), (n * (F.length("term") - F.length("chosen"))).cast("bigint").alias("saved_chars"))


_PATTERNS: dict[tuple, re.Pattern] = {}


def rewrite_text(text: str, mapping: dict[str, str]) -> str:
    """The same rewrite in plain Python, for the transformer of D3."""
    if not mapping or not text:
        return text
    key = tuple(sorted(mapping))
    pat = _PATTERNS.get(key)
    if pat is None:
        alts = "|".join(re.escape(t) for t in sorted(mapping, key=lambda t: (-len(t), t)))
        pat = _PATTERNS[key] = re.compile("(?<![A-Za-z])(?:" + alts + ")(?![A-Za-z])")
    return pat.sub(lambda m: mapping[m.group(0)], text)
