"""Conversation operators.

``turn`` orders the messages of a conversation; it may start anywhere, have
gaps and be of any type that sorts (numbers, time stamps, strings).  The
messages are cut into chunks by their rank, not by the value of ``turn``
(``ordered_chunks``), so no chunk holds more than ``chunk`` messages, however
sparse or dense the turns are.  "The message that directly follows" is found
inside a chunk and, for the last message of a chunk, among the first messages
of the chunks: no window over a whole conversation, and a huge conversation
spreads over many tasks by (conversation, chunk).  Messages of one conversation
and turn are ordered by role, then content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.chat import history_preview
from corpusmill.functions.text import is_blank
from corpusmill.plans.indexing import ordered_chunks
from corpusmill.session import scratch_table


def collect_messages(df: DataFrame, by: str = "conv_id", order: str = "turn",
                     role: str = "role", content: str = "text", chunk: int = 256) -> DataFrame:
    """One row per conversation with ``messages`` in turn order.  Built
    in two levels: message arrays per (conversation, chunk), then the
    chunk arrays flattened per conversation in chunk order, so a very long
    conversation spreads its sorting and collecting over many tasks; only
    the final array (the output row itself) is per conversation."""
    msg = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    rows = ordered_chunks(df.select(by, order, role, content), [by, order, role, content], chunk)
    parts = rows.groupBy(by, "_chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), msg.alias("_m")))),
                    lambda x: x["_m"]).alias("_part"))
    return parts.groupBy(by).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_part"))),
                              lambda x: x["_part"])).alias("messages"))


def ordered_concat(df: DataFrame, by: str, order: str, value: str, out: str, chunk: int = 256) -> DataFrame:
    """Concatenate ``value`` per ``by`` in ``order``, in two levels: pieces
    are joined per (by, chunk of ranks) first, then the few chunk strings
    per ``by``.  A very long conversation spreads its work over many tasks;
    only the final join of chunk strings (the output itself) is per group."""
    rows = ordered_chunks(df.select(by, order, value), [by, order, value], chunk)
    parts = rows.groupBy(by, "_chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"),
                                                                       F.col(value).alias("_v")))),
                                 lambda x: x["_v"]), "").alias("_part"))
    return parts.groupBy(by).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_part"))),
                                 lambda x: x["_part"]), "").alias(out))


def render_conversations(df: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role",
                         content: str = "text", default_system: str | None = None,
                         add_generation_prompt: bool = False, think_mode: bool | None = None,
                         out: str = "rendered") -> DataFrame:
    """E1/E2 over a turns table without gathering a conversation's messages:
    the smallest turn of each conversation (partial aggregate) marks the first
    message, which carries the system header or the default one; every other
    piece is known from its row, and the pieces are joined with
    ``ordered_concat``."""
    from corpusmill.functions.chat import DEFAULT_SYSTEM, IM_END, IM_START, generation_suffix, message_block
    default = DEFAULT_SYSTEM if default_system is None else default_system
    first = df.groupBy(by).agg(F.min(order).alias("_first"))
    df = df.select(by, order, role, content).join(first, by)
    r, starts = F.col(role), F.col(order) == F.col("_first")
    block = message_block(r, F.col(content))
    shown = r.isin("user", "assistant") | ((r == "system") & ~starts)
    piece = (F.when(starts & (r == "system"), block)
             .when(starts, F.concat(F.lit(IM_START + "system\n" + default + IM_END + "\n"),
                                    F.when(shown, block).otherwise(F.lit(""))))
             .when(shown, block).otherwise(F.lit("")))
    rendered = ordered_concat(df.select(by, order, piece.alias("_piece")), by, order, "_piece", out)
    suffix = generation_suffix(add_generation_prompt, think_mode)
    return rendered.withColumn(out, F.concat(F.col(out), F.lit(suffix))) if suffix else rendered


def turn_pairs(df: DataFrame, by: str = "conv_id", order: str = "turn",
               role: str = "role", content: str = "text", chunk: int = 256) -> DataFrame:
    """Each user message with the assistant reply that directly follows
    it; unanswered user messages (no next message, or not an assistant's)
    drop.  The chunk numbers are read twice, so they are written once."""
    message = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(content).alias("text"))
    ranked = scratch_table(ordered_chunks(df.select(by, order, role, content), [by, order, role, content], chunk), "turns")
    inside = F.lead("_m").over(Window.partitionBy(by, "_chunk").orderBy("_m"))
    rows = ranked.withColumn("_m", message).withColumn("_next", inside)
    # one row per chunk: the first message of the chunk after it
    firsts = ranked.groupBy(by, "_chunk").agg(F.min(message).alias("_f"))
    firsts = firsts.select(by, "_chunk", F.lead("_f").over(Window.partitionBy(by).orderBy("_chunk")).alias("_after"))
    follows = rows.filter(F.col(role) == "user").join(firsts, [by, "_chunk"]).withColumn("_next", F.coalesce("_next", "_after"))
    return follows.filter(F.col("_next.role") == "assistant").select(
        by, order, F.col(content).alias("user_text"), F.col("_next.text").alias("reply_text"))


def session_segments(df: DataFrame, by: str = "user_id", order=("ts", "event_id"),
                     text: str = "text", chunk_unit: str = "hour") -> DataFrame:
    """E5: chat input log -> context messages.

    ``clear`` (exact) starts a new context, ``exit`` (exact) ends the session
    including everything after it, blank input is ignored, commands are not
    messages.  ``segment`` = number of clears so far.  The running count and
    the exit flag come from ``running_totals``, which splits a hot user's log
    into time chunks instead of one window task."""
    from corpusmill.plans.scan import running_totals
    ts, tie = order
    t = F.col(text)
    marked = running_totals(
        df, by, ts, tie,
        sums={"segment": F.when(t == "clear", 1).otherwise(0)},
        maxes={"_closed": F.when(t == "exit", 1).otherwise(0)},
        unit=chunk_unit)
    kept = marked.filter((F.col("_closed") == 0) & ~t.isin("clear") & ~is_blank(text))
    return kept.drop("_closed")


def history_rows(df: DataFrame, role: str = "role", content: str = "text") -> DataFrame:
    """Preview text per message; roles other than system, user and
    assistant are not shown."""
    return df.withColumn("preview", history_preview(role, content)).filter(F.col("preview").isNotNull())


def chunk_assembly(df: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """I2 (batch form): text so far after each chunk of a request."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("so_far", F.array_join(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w), ""))
