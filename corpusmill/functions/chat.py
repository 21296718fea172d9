"""Chat-template Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import col_of, strip

IM_START = "<|im_start|>"
IM_END = "<|im_end|>"

# Our own default system text (the caller may pass another one).
DEFAULT_SYSTEM = "You are a careful assistant. Think step by step when a problem needs it, then answer clearly."


def message_block(role: Column, content: Column) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>\\n``; null content renders empty."""
    return F.concat(F.lit(IM_START), role, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(IM_END + "\n"))


def render_chat(messages, default_system: str = DEFAULT_SYSTEM,
                add_generation_prompt: bool = False, think_mode: bool | None = None) -> Column:
    """Render ``array<struct<role,content>>`` with the chat template.

    A leading system message is emitted once; otherwise a default system block
    is emitted.  Then user, assistant and non-first system messages follow in
    order; any other role vanishes.  Text is not trimmed.
    """
    m = col_of(messages)
    first = F.try_element_at(m, F.lit(1))
    header = F.when(first.getField("role") == "system",
                    message_block(F.lit("system"), first.getField("content"))) \
              .otherwise(F.lit(IM_START + "system\n" + default_system + IM_END + "\n"))
    kept = F.filter(m, lambda x, i: x.getField("role").isin("user", "assistant")
                    | ((x.getField("role") == "system") & (i > 0)))
    body = F.array_join(F.transform(kept, lambda x: message_block(x.getField("role"), x.getField("content"))), "")
    return F.concat(header, body, F.lit(generation_suffix(add_generation_prompt, think_mode)))


def generation_suffix(add_generation_prompt: bool, think_mode: bool | None) -> str:
    """The optional assistant prefix; think mode on/off/unset."""
    if not add_generation_prompt:
        return ""
    suffix = IM_START + "assistant\n"
    if think_mode is True:
        suffix += "<think>\n\n"
    elif think_mode is False:
        suffix += "<think></think>\n\n"
    return suffix


# Markers removed from a generated reply, in removal order.
REPLY_NOISE = ("<tool_call>", "</tool_call>", "<|im_end|>")


def clean_reply(c) -> Column:
    """Drop tool-call markers and the end marker, then strip."""
    out = col_of(c)
    for token in REPLY_NOISE:
        out = F.replace(out, F.lit(token), F.lit(""))
    return strip(out)


def history_preview(role, content, limit: int = 100) -> Column:
    """System text cut to ``limit`` characters plus ``...`` when longer;
    user and assistant text whole; other roles are not shown (null)."""
    role, content = col_of(role), col_of(content)
    cut = F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit("..."))).otherwise(content)
    return (F.when(role == "system", cut)
            .when(role.isin("user", "assistant"), content))
