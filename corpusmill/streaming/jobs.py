"""Streaming jobs.

Input is a folder of JSON-lines files; output a parquet folder.  Every
stream has its own checkpoint location under the shared checkpoint root, so
a restarted job resumes where it stopped.  ``availableNow`` processes what is
there and stops; ``max_files`` bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from corpusmill.operators.think import (finish_think_stats, format_reasons, pick_text_field, think_features,
                                        think_stats_aggs)
from corpusmill.operators.validate import drop_incomplete_qa, format_qa, route_format
from corpusmill.sources.jsonl import parse_lines, strict_rows, text_lines


def _parsed(spark: SparkSession, in_dir: str, schema: str, max_files: int | None) -> DataFrame:
    """The lines of the folder's files, tested as the batch reader tests them."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return parse_lines(text_lines(reader.load(in_dir)), schema)


def _source(spark: SparkSession, in_dir: str, schema: str, max_files: int | None, bad_dir: str | None = None,
            checkpoint: str | None = None) -> DataFrame:
    """Rows of the stream.  A bad line fails the job, or, with ``bad_dir``, is
    written there as (file, value) by a query with a checkpoint of its own."""
    if bad_dir is None:
        return strict_rows(_parsed(spark, in_dir, schema, max_files))
    bad = _parsed(spark, in_dir, schema, max_files).filter("bad").select("file", "value")
    _run(bad, bad_dir, f"{checkpoint}-bad-lines")
    return _parsed(spark, in_dir, schema, max_files).filter(~F.col("bad")).select("row.*")


def _run(df: DataFrame, out_dir: str, checkpoint: str, mode: str = "append"):
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out_dir))
    q.awaitTermination()
    return q


def prepare_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str,
                   max_files: int | None = None, bad_dir: str | None = None):
    """New JSONL files -> route -> drop incomplete -> format -> gate ->
    parquet.  The same stateless functions as the batch job; qa rows carry
    the format-gate reasons and verdict (null for text and io rows)."""
    src = _source(spark, in_dir, schema, max_files, bad_dir, checkpoint)
    out = format_qa(drop_incomplete_qa(route_format(src)))
    is_qa = F.col("kind") == "qa"
    out = out.withColumn("reasons", F.when(is_qa, format_reasons("text"))) \
             .withColumn("passed", F.when(is_qa, F.size("reasons") == 0))
    return _run(out, out_dir, checkpoint)


# ---- I2: text so far per request ------------------------------------------------

CHUNK_OUT = "conv_id long, turn long, so_far string"
CHUNK_STATE = "next_turn long, so_far string, missing long, held_turns array<long>, held_texts array<string>"


def _assemble(key, batches: Iterator[pd.DataFrame], state, first: int = 0, gap_ttl_ms: int | None = None):
    turn, text, missing, turns, texts = state.get if state.exists else (first, "", 0, [], [])
    held = dict(zip(turns, texts))
    out = []

    def take():
        nonlocal turn, text
        while turn in held:
            text += held.pop(turn) or ""
            out.append((key[0], turn, text, missing))
            turn += 1

    if state.hasTimedOut:  # the chunks before the held ones are given up
        for after in sorted(held):
            if after in held:
                missing, turn = missing + after - turn, after
                take()
        yield _chunk_rows(out, gap_ttl_ms)
    for pdf in batches:  # one piece of the group at a time
        out.clear()
        for t, chunk in zip(pdf["turn"], pdf["text"]):
            if t >= turn and int(t) not in held:  # not a replay
                held[int(t)] = chunk
        take()
        yield _chunk_rows(out, gap_ttl_ms)
    turns = sorted(held)
    state.update((turn, text, missing, turns, [held[t] for t in turns]))
    if held and gap_ttl_ms is not None:
        state.setTimeoutDuration(gap_ttl_ms)


def _chunk_rows(rows, gap_ttl_ms) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "so_far", "missing"])
    return pdf.drop(columns="missing") if gap_ttl_ms is None else pdf


def chunk_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                 max_files: int | None = None, bad_dir: str | None = None, first: int = 0,
                 gap_ttl_ms: int | None = None):
    """Per request (conv_id), the concatenation of its chunks after each
    chunk; chunks are numbered ``first``, ``first`` + 1 ...  State per key: the
    next number, the text so far and the chunks that came before their
    predecessors, which are held until these arrive.  Replays are skipped.

    All files are taken and the query ends; ``incomplete_requests`` then tells
    which requests still hold chunks.  With ``gap_ttl_ms`` the running query is
    returned, and a request that holds chunks and gets none for that time goes
    on after the gap; its rows tell in ``missing`` how many chunks were left
    out so far, and such chunks are skipped as replays if they come later."""
    src = _source(spark, in_dir, "conv_id long, turn long, role string, text string", max_files, bad_dir, checkpoint)
    chunks = src.select("conv_id", "turn", "text").groupBy("conv_id")
    assemble = partial(_assemble, first=first, gap_ttl_ms=gap_ttl_ms)
    if gap_ttl_ms is None:
        out = chunks.applyInPandasWithState(assemble, CHUNK_OUT, CHUNK_STATE, "append", GroupStateTimeout.NoTimeout)
        return _run(out, out_dir, checkpoint)
    out = chunks.applyInPandasWithState(assemble, f"{CHUNK_OUT}, missing long", CHUNK_STATE, "append",
                                        GroupStateTimeout.ProcessingTimeTimeout)
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(out_dir)


def incomplete_requests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The requests of a ``chunk_stream`` that hold chunks whose predecessors
    have not come: (conv_id, expected_turn, held_turns, so_far), read from the
    state of its last finished micro-batch."""
    state = spark.read.format("statestore").load(checkpoint)
    value = "value.groupState"
    return state.filter(F.size(f"{value}.held_turns") > 0).select(
        "key.conv_id", F.col(f"{value}.next_turn").alias("expected_turn"), f"{value}.held_turns", f"{value}.so_far")


# ---- I3: chat sessions -------------------------------------------------------

SESSION_OUT = "user_id long, event_id long, segment long, text string"
SESSION_STATE = "segment long, closed boolean, last_ts string, last_event long"


def _sessions(key, batches: Iterator[pd.DataFrame], state, closed_ttl_ms: int | None = None):
    from corpusmill.functions.text import WS
    if state.hasTimedOut:
        state.remove()
        return
    segment, closed, last_ts, last_event = state.get if state.exists else (0, False, "", -1)
    # the rows of one user in one micro-batch (``max_files`` bounds it) are put in order
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
    out = []
    for ts, event_id, text in zip(pdf["ts"], pdf["event_id"], pdf["text"]):
        if (ts, event_id) < (last_ts, last_event):
            raise ValueError(f"user {key[0]}: event {event_id} at {ts} came after event {last_event} at {last_ts}")
        last_ts, last_event = ts, int(event_id)
        if closed:
            continue
        if text == "exit":
            closed = True
        elif text == "clear":
            segment += 1
        elif text is not None and text.strip(WS):
            out.append((key[0], int(event_id), segment, text))
    state.update((segment, closed, last_ts, last_event))
    if closed and closed_ttl_ms is not None:
        state.setTimeoutDuration(closed_ttl_ms)
    yield pd.DataFrame(out, columns=["user_id", "event_id", "segment", "text"])


def session_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   max_files: int | None = None, ts_type: str = "timestamp_ntz", bad_dir: str | None = None,
                   closed_ttl_ms: int | None = None):
    """E5 over a stream.  State per user: (segment, closed, last event);
    rows of a micro-batch are ordered by (ts, event_id), and a row that comes
    after a later one of an earlier micro-batch fails the job.  ``ts`` is read
    as wall-clock time without a zone, so the session time zone cannot reorder
    rows.

    With ``closed_ttl_ms`` the state of an ended session is dropped after that
    time; this takes a query that goes on, so the running query is returned.
    Without it, all files are taken and the query ends."""
    src = _source(spark, in_dir, f"user_id long, ts {ts_type}, event_id long, text string", max_files, bad_dir, checkpoint)
    # wall-clock text with all digits sorts as the time does
    src = src.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    timeout = GroupStateTimeout.NoTimeout if closed_ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = src.groupBy("user_id").applyInPandasWithState(
        partial(_sessions, closed_ttl_ms=closed_ttl_ms), SESSION_OUT, SESSION_STATE, "append", timeout)
    if closed_ttl_ms is None:
        return _run(out, out_dir, checkpoint)
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).start(out_dir)


# ---- I4: running think statistics --------------------------------------------

def stats_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str,
                 max_files: int | None = None, bad_dir: str | None = None):
    """I4: F5 kept incrementally: a streaming global aggregate of sums
    (complete mode, one state row).  Every micro-batch writes its one row to a
    folder of its own; ``read_stats`` reads the newest and divides."""
    src = _source(spark, in_dir, schema, max_files, bad_dir, checkpoint)
    agg = think_features(src, pick_text_field(src)).agg(*think_stats_aggs())

    def write(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    q = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_stats(spark: SparkSession, out_dir: str) -> DataFrame:
    """The statistics of the newest finished micro-batch."""
    epochs = spark.read.parquet(out_dir)
    newest = epochs.agg(F.max("epoch")).first()[0]
    return finish_think_stats(epochs.filter(F.col("epoch") == newest))
