"""Encoding, labels, padding, batching and length profile (H1, H3-H8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.tokens import SPECIAL_TOKENS, tokenize
from corpusmill.plans.indexing import dense_index
from corpusmill.plans.scan import spread
from corpusmill.session import scratch_table

# settings (defaults of the training settings file)
MAX_LENGTH = 8192
BATCH_SIZE = 4
GRAD_ACCUM = 4
EPOCHS = 3
PAD_MULTIPLE = 8
LABEL_PAD = -100
UNK_ID = -1
PAD_TOKEN = "<|endoftext|>"
# the most frequent tokens (smallest ids), of at most so many bytes each, go to
# every task; their number and size are fixed, whatever the vocabulary
HEAD_TOKENS = 1 << 16
HEAD_TOKEN_BYTES = 64
LOOKUP_ROWS = 512  # rows whose tokens a task looks up at once


def _head_ids(head: pa.Table):
    """For ``mapInArrow`` over (key, row, tokens): (key, row, ids, tail).  Tokens
    of the head have their id; the others are in ``tail``, and where the n-th of
    a row stood (n from 0) is -2 - n."""
    known = head["token"].combine_chunks()
    numbers = np.append(head["id"].to_numpy(), 0).astype("int32")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, LOOKUP_ROWS):
                key, row, lists = batch.slice(at, LOOKUP_ROWS).columns
                flat = lists.flatten()
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
                found = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False)
                seen = np.append(0, np.cumsum(found < 0))  # tail tokens before each token
                ids = np.where(found < 0, -2 - (seen[:-1] - np.repeat(seen[ends[:-1]], np.diff(ends))), numbers[found])
                tail = flat.filter(pa.array(found < 0))
                yield pa.RecordBatch.from_arrays(
                    [key, row, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(seen[ends], pa.int32()), tail)], ["key", "row", "ids", "tail"])

    return run


def encode(df: DataFrame, vocab: DataFrame, text: str = "text", key: str = "sample_id",
           max_length: int = MAX_LENGTH, special=SPECIAL_TOKENS, unk_id: int = UNK_ID,
           tokens_col: str | None = None) -> DataFrame:
    """H3: tokens -> ids, cut on the right to ``max_length``; (key, input_ids).
    ``key`` must be unique.

    A task looks the tokens of its rows up in the vocabulary's head, which has a
    fixed size.  Only the others become rows of their own, for one shuffle join,
    which frequent tokens therefore never reach; their ids return by key and take
    the places kept for them.  ``tokens_col`` reuses a tokenized column."""
    if tokens_col is None:
        df, tokens_col = tokenized(df, text, key, special), "tokens"
    # bytes first, count second: a long token must not use up the head's places
    known = vocab.select("token", F.col("token_id").cast("int").alias("id"))
    in_head = (F.col("id") < HEAD_TOKENS) & (F.octet_length("token") <= HEAD_TOKEN_BYTES)
    head = pa.Table.from_pandas(known.filter(in_head).toPandas(), pa.schema({"token": pa.string(), "id": pa.int32()}), preserve_index=False)
    tokens = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.slice(tokens_col, 1, max_length).alias("tokens"))
    key_type = df.schema[key].dataType.simpleString()
    first = scratch_table(tokens.mapInArrow(_head_ids(head), f"key {key_type}, row bigint, ids array<int>, tail array<string>"), "head-ids")
    tail = first.select("key", "row", F.posexplode("tail").alias("n", "token")).join(known.filter(~in_head), "token", "left")
    both = first.select("key", F.struct("row", "ids").alias("own"), F.lit(None).cast("struct<row:bigint,n:int,id:int>").alias("late")).unionByName(
        tail.select("key", F.lit(None).cast("struct<row:bigint,ids:array<int>>").alias("own"),
                    F.struct("row", "n", F.coalesce("id", F.lit(unk_id)).alias("id")).alias("late")))
    merged = both.groupBy("key").agg(F.collect_list("own").alias("own"), F.sort_array(F.collect_list("late")).alias("late"))
    return merged.select(F.col("key").alias(key), _in_place("own", "late").alias("input_ids"))


def _in_place(own: str, late: str) -> Column:
    """The ids of a key: those of its row, with the late ones at their places.
    Rows that share a key are merged by position, then id."""
    def whole(ids, found):  # ``found`` is looked into for every late id, so it must be a value, no expression
        return F.transform(ids, lambda i: F.when(i < -1, F.get(found, -2 - i)["id"]).otherwise(i))

    def code(i, at):
        return F.shiftleft(at.cast("bigint"), 32).bitwiseOR(i.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))

    only = F.get(own, F.lit(0))["ids"]
    rows = F.transform(own, lambda o: F.struct(o["ids"].alias("ids"), F.filter(late, lambda x: x["row"] == o["row"]).alias("found")))
    codes = F.sort_array(F.flatten(F.transform(rows, lambda r: F.transform(whole(r["ids"], r["found"]), code))))
    merged = F.transform(codes, lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int"))
    return F.when(F.size(own) > 1, merged).when(F.size(late) == 0, only).otherwise(whole(only, F.col(late)))


def with_labels(df: DataFrame) -> DataFrame:
    """H4: labels are a copy of the ids (prompt tokens are not masked)."""
    return df.withColumn("labels", F.col("input_ids"))


def token_lengths(toks: DataFrame, key: str = "sample_id", tokens_col: str = "tokens",
                  max_length: int = MAX_LENGTH) -> DataFrame:
    """(key, n_tokens) after the right cut, from a token table."""
    return toks.select(key, F.least(F.size(tokens_col), F.lit(max_length)).cast("bigint").alias("n_tokens"))


def tokenized(df: DataFrame, text: str, key: str, special=SPECIAL_TOKENS, out: str = "tokens") -> DataFrame:
    """(key, tokens) computed once and written to the shared folder, so the
    vocabulary and the encoder read it instead of tokenizing twice (the regex
    pass is the costly part)."""
    return scratch_table(spread(df.select(key, F.col(text).alias("_text"))).select(key, tokenize("_text", special).alias(out)), "tokens")


def pad_token_id(vocab: DataFrame, token: str = PAD_TOKEN) -> int:
    """The id of the padding token; the vocabulary must hold it
    (``add_special_tokens`` adds it where the corpus does not)."""
    row = vocab.filter(F.col("token") == token).select("token_id").first()
    if row is None:
        raise ValueError(f"{token} is not in the vocabulary")
    return int(row["token_id"])


def padded_lengths(lengths: DataFrame, plan: DataFrame, key: str = "sample_id", multiple: int = PAD_MULTIPLE) -> DataFrame:
    """(key, epoch, batch_id, n_tokens, padded_len): the micro-batches the plan
    (``epoch_plan``) draws, each as long as its longest row, rounded up to
    ``multiple``.  Light rows only; windows are over one batch."""
    rows = plan.select(key, "epoch", F.col("micro_batch").alias("batch_id")).join(
        lengths.select(key, F.col("n_tokens").cast("bigint").alias("n_tokens")), key)
    longest = F.max("n_tokens").over(Window.partitionBy("epoch", "batch_id"))
    return rows.withColumn("padded_len", (F.ceil(longest / multiple) * multiple).cast("bigint"))


def pad_batch(df: DataFrame, batches: DataFrame, pad_id: int, key: str = "sample_id", label_pad: int = LABEL_PAD) -> DataFrame:
    """H5: every row of ``batches`` (``padded_lengths``) with its arrays padded:
    ids with ``pad_id``, labels with ``label_pad``, mask with 0."""
    own = [c for c in ("labels",) if c in df.columns]  # a copy of the ids is made after the join
    out = df.select(key, "input_ids", *own).join(batches, key)
    if not own:
        out = with_labels(out)
    k = (F.col("padded_len") - F.col("n_tokens")).cast("int")
    return out.select(
        key, "epoch", "batch_id", "n_tokens", "padded_len",
        F.concat("input_ids", F.array_repeat(F.lit(pad_id), k)).alias("input_ids"),
        F.concat("labels", F.array_repeat(F.lit(label_pad), k)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.col("n_tokens").cast("int")), F.array_repeat(F.lit(0), k))
         .alias("attention_mask"))


def epoch_plan(df: DataFrame, key: str = "sample_id", epochs: int = EPOCHS, batch_size: int = BATCH_SIZE,
               accum: int = GRAD_ACCUM, seed: int = 42) -> DataFrame:
    """H6: a seeded order per epoch (md5 of seed, epoch and key; the same
    function exists in every SQL engine), then micro-batch and optimizer
    step numbers.  Global positions come from the range-sorted index; the
    position inside an epoch subtracts the epoch's first position (one
    small row per epoch, broadcast)."""
    e = df.select(key, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(epochs).cast("bigint"))).alias("epoch"))
    e = e.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                             F.col(key).cast("string"))))
    idx = dense_index(e, ["epoch", "_h", key], "_g")
    # first global position of each epoch: one row per epoch
    starts = idx.groupBy("epoch").agg(F.min("_g").alias("_start"))
    pos = (F.col("_g") - F.col("_start")).cast("bigint")
    return idx.join(F.broadcast(starts), "epoch").select(
        key, "epoch", pos.alias("position"),
        F.floor(pos / batch_size).cast("bigint").alias("micro_batch"),
        F.floor(pos / (batch_size * accum)).cast("bigint").alias("step"))


def padding_waste(batches: DataFrame) -> DataFrame:
    """H7: real tokens against padded slots per micro-batch (``padded_lengths``)
    plus the total (``is_total``, epoch and batch_id -1)."""
    per = batches.groupBy("epoch", "batch_id").agg(
        F.sum("n_tokens").cast("bigint").alias("real_tokens"), F.sum("padded_len").cast("bigint").alias("padded_slots"))
    agg = per.groupingSets([["epoch", "batch_id"], []], "epoch", "batch_id").agg(
        F.grouping_id().alias("_g"), F.sum("real_tokens").cast("bigint").alias("real_tokens"),
        F.sum("padded_slots").cast("bigint").alias("padded_slots"))
    total = F.col("_g") > 0
    return agg.select(F.when(total, F.lit(-1)).otherwise(F.col("epoch")).cast("bigint").alias("epoch"),
                      F.when(total, F.lit(-1)).otherwise(F.col("batch_id")).cast("bigint").alias("batch_id"),
                      total.alias("is_total"), "real_tokens", "padded_slots",
                      F.round(F.try_divide(F.col("padded_slots") - F.col("real_tokens"), F.col("padded_slots")) * 1.0, 4)
                      .alias("waste"))


def length_profile(df: DataFrame, n_col: str = "n_tokens", max_length: int = MAX_LENGTH) -> DataFrame:
    """H8: exact token-length quantiles (linear interpolation) and the share
    cut at ``max_length``.  ``percentile`` keeps a value->count map, bounded
    by the number of distinct lengths, and merges partially."""
    n = F.col(n_col)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.round(F.percentile(n, F.lit(0.5)), 4).alias("p50"),
        F.round(F.percentile(n, F.lit(0.9)), 4).alias("p90"),
        F.round(F.percentile(n, F.lit(0.99)), 4).alias("p99"),
        F.max(n).cast("bigint").alias("max_len"),
        F.round(F.avg((n > max_length).cast("double")), 4).alias("share_truncated"))
