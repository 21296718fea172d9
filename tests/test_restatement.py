"""Pure-Python statements of D4, E1 and H5 compared with Spark on random
"""

import random


from corpusmill.functions.chat import render_chat
from corpusmill.operators.batches import epoch_plan, pad_batch, padded_lengths
from corpusmill.operators.conversations import collect_messages
from corpusmill.operators.rewrite import choose_candidate, rewrite
from tests.scripted import ScriptedTransformer


def _py_accept(script, original, max_retries):
    """The accept rule written as a plain retry loop over scripted answers."""
    budget = len(original)

    def answer(attempt, kind):
        idx = attempt * 2 + (1 if kind == "focus" else 0)
        a = script[idx] if idx < len(script) else None
        if isinstance(a, Exception):
            raise a
        return a

    for attempt in range(max_retries):
        try:
            content = answer(attempt, "primary")
            if content and content.strip():
                text = content.strip()
                if len(text) <= budget:
                    return "rewritten", text
                if attempt == 0:
                    retry = answer(attempt, "focus")
                    if retry:
                        r = retry.strip()
                        if len(r) <= budget:
                            return ("rewritten", r) if r else ("failed", None)
                        return "kept_long", original
                else:
                    return "kept_long", original
        except Exception:  # noqa: BLE001
            pass
    return "failed", None


def test_accept_rule_random(spark):
    rnd = random.Random(11)
    original = "Alpha beta gamma. Delta epsilon."
    pool = ["short", original + " and more", "", " \n", None, RuntimeError("x"), "  tiny  "]
    scripts = {i: [rnd.choice(pool) for _ in range(rnd.randint(0, 6))] for i in range(200)}
    for max_retries in (1, 3):
        samples = spark.createDataFrame([(i, " " + original + "\n") for i in scripts], "sample_id long, solution string")
        log = rewrite(samples, ScriptedTransformer(scripts), max_retries=max_retries, retry_delay=0.0)
        got = {r.sample_id: (r.outcome, r.chosen) for r in choose_candidate(samples, log, max_retries).collect()}
        want = {i: _py_accept(s, original, max_retries) for i, s in scripts.items()}
        assert got == want


def _py_render(messages, default):
    out = ""
    if messages and messages[0][0] == "system":
        out += f"<|im_start|>system\n{messages[0][1]}<|im_end|>\n"
    else:
        out += f"<|im_start|>system\n{default}<|im_end|>\n"
    for i, (role, content) in enumerate(messages):
        if role in ("user", "assistant") or (role == "system" and i > 0):
            out += f"<|im_start|>{role}\n{content}<|im_end|>\n"
    return out


def test_render_random(spark):
    rnd = random.Random(5)
    roles = ["system", "user", "assistant", "tool"]
    convs = {c: [(rnd.choice(roles), rnd.choice(["", "x", " y\n", "안녕", "<think>z</think>"]))
                 for _ in range(rnd.randint(1, 6))] for c in range(150)}
    rows = [(c, t, r, txt) for c, ms in convs.items() for t, (r, txt) in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.x for r in collect_messages(df).select("conv_id", render_chat("messages", "D").alias("x")).collect()}
    assert got == {c: _py_render(ms, "D") for c, ms in convs.items()}


def test_pad_batch_random(spark):
    rnd = random.Random(9)
    keys = rnd.sample(range(10_000), 103)
    rows = [(k, [rnd.randint(0, 50) for _ in range(rnd.randint(0, 30))]) for k in keys]
    df = spark.createDataFrame(rows, "sample_id long, input_ids array<int>")
    lengths = spark.createDataFrame([(k, len(ids)) for k, ids in rows], "sample_id long, n_tokens long")
    plan = epoch_plan(lengths, epochs=2, batch_size=4)
    got = {(r.sample_id, r.epoch): (r.batch_id, r.padded_len, list(r.input_ids), list(r.labels), list(r.attention_mask))
           for r in pad_batch(df, padded_lengths(lengths, plan, multiple=8), 99).collect()}
    ids, batches = dict(rows), {}
    for r in plan.collect():
        batches.setdefault((r.epoch, r.micro_batch), []).append(r.sample_id)
    want = {}
    for (epoch, b), members in batches.items():
        assert len(members) <= 4
        padded = -(-max(len(ids[k]) for k in members) // 8) * 8
        for k in members:
            pad = padded - len(ids[k])
            want[k, epoch] = (b, padded, ids[k] + [99] * pad, ids[k] + [-100] * pad, [1] * len(ids[k]) + [0] * pad)
    assert got == want and len(want) == 206


def test_render_conversations_equals_array_form(spark):
    from corpusmill.operators.conversations import render_conversations
    rnd = random.Random(8)
    roles = ["system", "user", "assistant", "tool"]
    convs = {c: [(rnd.choice(roles), rnd.choice(["", "x", "안녕 ", None])) for _ in range(rnd.randint(1, 700))]
             for c in range(12)}
    rows = [(c, t, r, txt) for c, ms in convs.items() for t, (r, txt) in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {r.conv_id: r.x for r in collect_messages(df).select("conv_id", render_chat("messages", "D", True, False).alias("x")).collect()}
    got = {r.conv_id: r.rendered for r in render_conversations(df, default_system="D", add_generation_prompt=True,
                                                                 think_mode=False).collect()}
    assert got == want
