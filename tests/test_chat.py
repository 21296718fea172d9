from pyspark.sql import functions as F

from corpusmill.functions.chat import clean_reply, history_preview, render_chat
from corpusmill.operators.conversations import collect_messages, session_segments, turn_pairs

B = lambda r, c: f"<|im_start|>{r}\n{c}<|im_end|>\n"


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_render_cases(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "u"), (1, 2, "system", "S2"), (1, 3, "tool", "t"),
            (1, 4, "assistant", ""), (2, 0, "user", "hi")]
    m = collect_messages(_turns(spark, rows))
    got = {r.conv_id: r.x for r in m.select("conv_id", render_chat("messages", "D").alias("x")).collect()}
    assert got[1] == B("system", "S") + B("user", "u") + B("system", "S2") + B("assistant", "")
    assert got[2] == B("system", "D") + B("user", "hi")


def test_generation_prompt_modes(spark):
    m = collect_messages(_turns(spark, [(1, 0, "user", "hi")]))
    on, off, unset = m.select(render_chat("messages", "D", True, True), render_chat("messages", "D", True, False),
                              render_chat("messages", "D", True, None)).first()
    base = B("system", "D") + B("user", "hi") + "<|im_start|>assistant\n"
    assert (on, off, unset) == (base + "<think>\n\n", base + "<think></think>\n\n", base)


def test_turn_pairs_direct_reply_only(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "r")]
    assert [(r.turn, r.reply_text) for r in turn_pairs(_turns(spark, rows)).collect()] == [(1, "r")]


def test_session_segments(spark):
    rows = [(1, 1, "clear"), (1, 2, "hello"), (1, 3, " clear"), (1, 4, "   "), (1, 5, "exit"), (1, 6, "after")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, text string").withColumn("ts", F.col("event_id").cast("timestamp"))
    got = [(r.event_id, r.segment) for r in session_segments(df).orderBy("event_id").collect()]
    assert got == [(2, 1), (3, 1)]


def test_clean_reply_and_preview(spark):
    df = spark.createDataFrame([("<tool_call>x</tool_call><|im_end|> ", "system", "a" * 100),
                                ("y", "system", "a" * 101)], "r string, role string, c string")
    rows = df.select(clean_reply("r").alias("x"), history_preview("role", "c").alias("p")).collect()
    assert rows[0].x == "x" and rows[0].p == "a" * 100 and rows[1].p == "a" * 100 + "..."


def test_collect_messages_long_conversation_order(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(1000)]
    m = collect_messages(_turns(spark, rows)).first()
    assert [x.content for x in m.messages] == [f"m{t}" for t in range(1000)]


def test_first_turn_and_gaps(spark):
    """Conversations may start at any turn and leave turns out."""
    from corpusmill.operators.conversations import render_conversations
    rows = [(1, 3, "user", "a"), (1, 900, "assistant", "b"), (1, 901, "system", "s"), (2, 5, "system", "S"), (2, 256, "user", "u"),
            (2, 5000, "tool", "t"), (2, 5001, "assistant", "x"), (3, 511, "user", "q"), (3, 512, "assistant", "r")]
    df = _turns(spark, rows)
    got = {r.conv_id: r.rendered for r in render_conversations(df, default_system="D").collect()}
    assert got == {1: B("system", "D") + B("user", "a") + B("assistant", "b") + B("system", "s"),
                   2: B("system", "S") + B("user", "u") + B("assistant", "x"), 3: B("system", "D") + B("user", "q") + B("assistant", "r")}
    assert sorted(map(tuple, turn_pairs(df).collect())) == [(1, 3, "a", "b"), (3, 511, "q", "r")]


def test_chunks_are_bounded_by_rank(spark):
    """A huge conversation of sparse turns, and one whose turns lie close: no
    chunk holds more rows than asked for, and the results do not depend on it."""
    import datetime as dt

    from corpusmill.operators.conversations import render_conversations
    from corpusmill.plans.indexing import ordered_chunks
    names = ["conv_id", "turn", "role", "text"]
    turns = [(1, t * 1_000_003, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(3000)]
    turns += [(2, t, "user" if t % 2 else "assistant", f"n{t}") for t in range(50)] + [(2, 7, "user", "n7")]  # a repeated row
    df = _turns(spark, turns).repartition(7)
    sizes = ordered_chunks(df, names, 64).groupBy("conv_id", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 and sizes.filter("conv_id = 1").count() >= 3000 / 64
    want = {c: [x[3] for x in sorted(turns) if x[0] == c] for c in (1, 2)}
    got = {r.conv_id: [m.content for m in r.messages] for r in collect_messages(df, chunk=64).collect()}
    assert got == want
    shown = {r.conv_id: r.rendered for r in render_conversations(df, default_system="D").collect()}
    assert shown[1] == B("system", "D") + "".join(B(r, t) for _, _, r, t in sorted(turns[:3000]))
    pairs = [(r.turn, r.user_text, r.reply_text) for r in turn_pairs(df, chunk=5).filter("conv_id = 1").collect()]
    assert sorted(pairs) == [(t * 1_000_003, f"m{t}", f"m{t + 1}") for t in range(0, 3000, 2)]
    start = dt.datetime(2024, 1, 1)
    stamped = spark.createDataFrame([(c, start + dt.timedelta(microseconds=t), r, x) for c, t, r, x in turns[3000:]],
                                    "conv_id long, turn timestamp_ntz, role string, text string")
    assert [m.content for m in collect_messages(stamped, chunk=8).first().messages] == want[2]
