"""Special tokens and the corpus vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from corpusmill.functions.tokens import KEEP_TOKENS, REMOVE_TOKENS, SPECIAL_TOKENS, THINK_TAGS, special_matches, tokenize
from corpusmill.plans.indexing import dense_index


def token_counts(df: DataFrame, text: str = "text", special=SPECIAL_TOKENS,
                 tokens_col: str | None = None) -> DataFrame:
    """Token frequencies; partial counts are combined map-side, so a hot
    token never ships more than one row per map task.  ``tokens_col`` reuses
    an already tokenized column."""
    arr = F.col(tokens_col) if tokens_col else tokenize(text, special)
    toks = df.select(F.explode(arr).alias("token"))
    return toks.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("freq"))


def build_vocab(df: DataFrame, text: str = "text", special=SPECIAL_TOKENS,
                tokens_col: str | None = None) -> DataFrame:
    """H2: (token, token_id, freq, is_special) over the tokens that occur.

    Special tokens first in list order, then by frequency (descending), ties
    by token.  Ids are dense from 0 and assigned by a range-sorted index, not
    a single-task window, because the vocabulary grows with the corpus."""
    counts = token_counts(df, text, special, tokens_col)
    rank = F.array_position(F.array(*[F.lit(t) for t in special]), F.col("token")) if special else F.lit(0)
    keyed = counts.withColumn("_srank", rank.cast("bigint")) \
        .withColumn("_plain", (F.col("_srank") == 0).cast("int")) \
        .withColumn("_negfreq", -F.col("freq"))
    idx = dense_index(keyed, ["_plain", "_srank", "_negfreq", "token"], "token_id")
    return idx.select("token", "token_id", "freq", (F.col("_plain") == 0).alias("is_special"))


def _equals(token: str):
    """A one-argument lambda for ``filter`` (a default argument would make
    PySpark pass the element index)."""
    return lambda x: x == F.lit(token)


def _list_df(spark, tokens, name: str = "token") -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], f"{name} string, list_pos int")


def keep_essential(vocab: DataFrame, essential=KEEP_TOKENS) -> DataFrame:
    """G1: special entries of the vocabulary that are essential; ids
    unchanged; essential tokens absent from the vocabulary are not added.
    Adds the special-entry counts before and after (one aggregate)."""
    special = vocab.filter("is_special").select("token", "token_id")
    inside = F.col("token").isin(list(essential))
    before, after = special.agg(F.count(F.lit(1)), F.count_if(inside)).first()
    return special.filter(inside).select("token", "token_id", F.lit(before).cast("bigint").alias("n_before"),
                                         F.lit(after).cast("bigint").alias("n_after"))


def token_diff(vocab: DataFrame, essential=KEEP_TOKENS) -> DataFrame:
    """Status of every special vocabulary entry and essential token:
    kept (both), removed (vocabulary only) or absent (essential only, id -1)."""
    special = vocab.filter("is_special").select("token", "token_id", F.lit(True).alias("_v"))
    ess = _list_df(vocab.sparkSession, essential).select("token", F.lit(True).alias("_e"))
    j = special.join(F.broadcast(ess), "token", "full_outer")
    status = F.when(F.col("_v") & F.col("_e"), "kept").when(F.col("_v"), "removed").otherwise("absent")
    return j.select("token", F.coalesce("token_id", F.lit(-1)).cast("bigint").alias("token_id"),
                    status.alias("status"))


def add_special_tokens(vocab: DataFrame, new=THINK_TAGS) -> DataFrame:
    """Tokens of ``new`` missing from the vocabulary get the next free
    ids (max id + 1, ... in list order).  Returns the grown vocabulary."""
    new = list(dict.fromkeys(new))
    top, present = vocab.agg(F.coalesce(F.max("token_id"), F.lit(-1)),
                             F.collect_set(F.when(F.col("token").isin(new), F.col("token")))).first()  # at most len(new) tokens
    missing = [t for t in new if t not in present]
    added = vocab.sparkSession.createDataFrame([(t, top + 1 + i, 0, True) for i, t in enumerate(missing)],
                                               "token string, token_id bigint, freq bigint, is_special boolean")
    return vocab.select("token", "token_id", "freq", "is_special").unionByName(added)


def token_audit(df: DataFrame, text: str = "text", tokens=REMOVE_TOKENS) -> DataFrame:
    """Per listed token, rows holding it and its occurrences.  One regex
    pass collects the listed tokens of each row (a short array), one global
    aggregate (partial per task) counts them, and the small result is
    unpivoted; tokens never seen report zeros."""
    m = df.select(special_matches(text, tokens).alias("_m"))
    aggs = []
    for i, t in enumerate(tokens):
        n = F.size(F.filter("_m", _equals(t)))
        aggs += [F.count_if(n > 0).alias(f"_r{i}"), F.coalesce(F.sum(n), F.lit(0)).alias(f"_o{i}")]
    agg = m.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(f"_r{i}").cast("bigint").alias("n_rows"),
                                        F.col(f"_o{i}").cast("bigint").alias("occurrences"))
                               for i, t in enumerate(tokens)]))
    return agg.select(rows.alias("r")).select("r.*")
