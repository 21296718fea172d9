"""Think-tag operators over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import col_of, strip
from corpusmill.functions.think import span_lengths, think_counts, think_spans
from corpusmill.functions.tokens import SPECIAL_TOKENS, THINK_TAGS, tokenize

# Candidate text fields, first present wins.
TEXT_FIELDS = ("formatted_response", "text", "solution", "content")

MAX_THINK_LENGTH = 8192
MIN_COVERAGE = 0.9


def pick_text_field(df: DataFrame, fields=TEXT_FIELDS) -> Column:
    """first present (non-null) field, cast to string.  An empty string is
    present, so it hides later fields."""
    present = [F.col(f).cast("string") for f in fields if f in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*present) if len(present) > 1 else present[0]


def think_span_rows(df: DataFrame, text="text", keys=("doc_id",), tags=THINK_TAGS) -> DataFrame:
    """one row per span: keys, pos (from 0), raw content, stripped length."""
    spans = df.select(*keys, F.posexplode(think_spans(text, *tags)).alias("pos", "content"))
    return spans.withColumn("n_chars", F.length(strip("content")).cast("bigint"))


def think_features(df: DataFrame, text: Column, keep=(), tags=THINK_TAGS) -> DataFrame:
    """Per-row numbers behind F5: has text, opens, closes, total stripped
    span characters and span count (nulls when the row has no text).  The
    span regex runs once per row, before any aggregation or ROLLUP expand."""
    has_text = F.coalesce(F.length(text) > 0, F.lit(False))
    opens, closes = think_counts(text, *tags)
    lens = span_lengths(think_spans(text, *tags))
    feats = df.select(*keep, has_text.alias("_has"), F.when(has_text, opens).alias("_o"),
                      F.when(has_text, closes).alias("_c"), F.when(has_text, lens).alias("_lens"))
    return feats.select(*keep, "_has", "_o", "_c",
                        F.aggregate("_lens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("_sc"),
                        F.size("_lens").alias("_sn"))


def think_stats_aggs():
    """Aggregates of F5 over ``think_features`` columns (sums only, so they
    merge partially and can be kept by a stream); ``finish_think_stats``
    turns them into the six published numbers."""
    has, o, c = F.col("_has"), F.col("_o"), F.col("_c")
    return [
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(has & ((o > 0) | (c > 0))).alias("samples_with_think_tokens"),
        F.count_if(has & (o == c) & (o > 0)).alias("samples_with_balanced_tokens"),
        F.coalesce(F.sum(o), F.lit(0)).cast("bigint").alias("total_think_opens"),
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total_think_closes"),
        F.coalesce(F.sum(F.when(has, F.col("_sc"))), F.lit(0)).cast("bigint").alias("span_chars"),
        F.coalesce(F.sum(F.when(has, F.col("_sn"))), F.lit(0)).cast("bigint").alias("span_count"),
    ]


STAT_COLUMNS = ("total_samples", "samples_with_think_tokens", "samples_with_balanced_tokens",
                "total_think_opens", "total_think_closes", "average_think_length")


def finish_think_stats(agg: DataFrame, keep=()) -> DataFrame:
    """Floor of span characters over span count, 0 when there is no span."""
    avg = F.expr("coalesce(span_chars div nullif(span_count, 0), 0)").cast("bigint")
    return agg.select(*keep, *STAT_COLUMNS[:-1], avg.alias("average_think_length"))


def think_stats(df: DataFrame, text=None, fields=TEXT_FIELDS, by=None, tags=THINK_TAGS) -> DataFrame:
    """one record over the whole table.  Rows without text count in
    ``total_samples`` only.  One pass, partial aggregation, no explode.
    With ``by`` this is F6 (per group plus the total)."""
    if by:
        return think_stats_by(df, by, text=text, fields=fields, tags=tags)
    t = pick_text_field(df, fields) if text is None else col_of(text)
    return finish_think_stats(think_features(df, t, tags=tags).agg(*think_stats_aggs()))


def think_stats_by(df: DataFrame, by, text=None, fields=TEXT_FIELDS, tags=THINK_TAGS) -> DataFrame:
    """F5 per group plus the grand total (``is_total``) via ROLLUP."""
    by = [by] if isinstance(by, str) else list(by)
    t = pick_text_field(df, fields) if text is None else col_of(text)
    agg = think_features(df, t, keep=by, tags=tags).rollup(*by).agg(F.grouping_id().alias("_gid"), *think_stats_aggs())
    agg = agg.withColumn("is_total", F.col("_gid") > 0)
    return finish_think_stats(agg, keep=[*by, "is_total"])


def max_span_length(text, tags=THINK_TAGS) -> Column:
    lens = span_lengths(think_spans(text, *tags))
    return F.coalesce(F.array_max(lens), F.lit(0).cast("bigint"))


def max_think_length(df: DataFrame, n: int = MAX_THINK_LENGTH, text="text", tags=THINK_TAGS) -> DataFrame:
    """drop rows holding a span longer than ``n`` characters (stripped)."""
    return df.filter(~F.exists(span_lengths(think_spans(text, *tags)), lambda x: x > n))


def coverage_gate(df: DataFrame, min_share: float = MIN_COVERAGE, text="text",
                  raise_on_fail: bool = False, tags=THINK_TAGS) -> DataFrame:
    """share of rows with any think tag; ``passed`` when >= min_share.
    With ``raise_on_fail`` the job fails (on the executors) when the gate fails."""
    opens, closes = think_counts(text, *tags)
    has_tag = ((opens > 0) | (closes > 0)).cast("double")
    out = df.agg(F.coalesce(F.avg(has_tag), F.lit(0.0)).alias("share"))
    out = out.withColumn("passed", F.col("share") >= F.lit(min_share))
    if raise_on_fail:
        out = out.filter(F.when(F.col("passed"), F.lit(True))
                         .otherwise(F.raise_error(F.lit("think-tag coverage below %s" % min_share))))
    return out


def coverage_counts(wanted: Column, text="text", tags=THINK_TAGS) -> list[Column]:
    """F10 as counts for ``observe``: the ``wanted`` rows, and those of them
    with any think tag."""
    opens, closes = think_counts(text, *tags)
    return [F.count_if(wanted).alias("n_rows"), F.count_if(wanted & ((opens > 0) | (closes > 0))).alias("n_tagged")]


def observed_coverage(spark: SparkSession, counts: Observation, min_share: float = MIN_COVERAGE) -> DataFrame:
    """F10 from the counts that a write observed; the row of ``coverage_gate``."""
    n, tagged = (counts.get.get(k) or 0 for k in ("n_rows", "n_tagged"))
    share = tagged / n if n else 0.0
    return spark.range(1).select(F.lit(share).cast("double").alias("share"), F.lit(share >= min_share).alias("passed"))


# Reason codes of the format gate, in check order.
GATE_REASONS = ("no_tags", "unbalanced", "misordered", "too_long")


def format_reasons(text, max_len: int = MAX_THINK_LENGTH, tags=THINK_TAGS, check_balance: bool = True) -> Column:
    """reason codes of a row; empty array = passed.

    no_tags: neither tag occurs; unbalanced: counts differ; misordered: counts
    agree but fewer well-formed spans than opens (a close before its open);
    too_long: a span longer than ``max_len`` characters.  Without
    ``check_balance`` unbalanced and misordered are not looked for."""
    opens, closes = think_counts(text, *tags)
    spans = think_spans(text, *tags)
    balance = [F.when(opens != closes, F.lit("unbalanced")),
               F.when((opens == closes) & (F.size(spans) < opens), F.lit("misordered"))]
    return F.array_compact(F.array(
        F.when((opens == 0) & (closes == 0), F.lit("no_tags")),
        *(balance if check_balance else []),
        F.when(F.exists(span_lengths(spans), lambda x: x > max_len), F.lit("too_long")),
    ))


def format_gate(df: DataFrame, text="text", max_len: int = MAX_THINK_LENGTH, tags=THINK_TAGS,
                check_balance: bool = True) -> DataFrame:
    reasons = format_reasons(text, max_len, tags, check_balance)
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def tags_after_truncation(df: DataFrame, max_len: int, text="text", tags=THINK_TAGS, special=SPECIAL_TOKENS) -> DataFrame:
    """tokens are cut on the right at ``max_len``; rows balanced before
    the cut and unbalanced after it are ``broken``.  ``special`` must hold the
    tags."""
    toks = tokenize(text, special)
    kept = F.slice(toks, 1, max_len)

    def tag_count(arr, tag):
        return F.size(F.filter(arr, lambda x: x == tag)).cast("bigint")

    out = df.withColumn("_toks", toks).withColumn("_kept", kept)
    out = out.select(
        "*",
        F.size("_toks").cast("bigint").alias("n_tokens"),
        tag_count(F.col("_toks"), tags[0]).alias("opens"),
        tag_count(F.col("_toks"), tags[1]).alias("closes"),
        tag_count(F.col("_kept"), tags[0]).alias("kept_opens"),
        tag_count(F.col("_kept"), tags[1]).alias("kept_closes"),
    ).drop("_toks", "_kept")
    return out.withColumn("broken", (F.col("opens") == F.col("closes"))
                          & (F.col("kept_opens") != F.col("kept_closes")))
