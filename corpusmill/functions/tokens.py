"""Special-token lists and the built-in tokenizer pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import WS_CLASS_BODY, col_of, regex_escape

# Special tokens the training settings keep, in settings order.
KEEP_TOKENS = ("<|im_start|>", "<|im_end|>", "<think>", "</think>", "<|endoftext|>")

# Special tokens the training settings mark for removal, in
# settings order.
REMOVE_TOKENS = (
    "<tool_call>", "</tool_call>", "<|box_start|>", "<|box_end|>", "<|vision_start|>",
    "<|vision_end|>", "<|vision_pad|>", "<|video_pad|>", "<|image_pad|>", "<|quad_start|>",
    "<|quad_end|>", "<|object_ref_start|>", "<|object_ref_end|>", "<|fim_prefix|>",
    "<|fim_middle|>", "<|fim_suffix|>", "<|fim_pad|>", "<|file_sep|>", "<|repo_name|>",
)

SPECIAL_TOKENS = KEEP_TOKENS + REMOVE_TOKENS
THINK_TAGS = ("<think>", "</think>")


def special_alternation(special) -> str:
    """One pattern for the literal tokens: tokens sharing a first character
    are factored behind it (``<(?:...)``), longest first, so a position that
    cannot start a token fails after one comparison.  Leftmost-first
    matching, the same in Java and RE2."""
    by_first: dict[str, list[str]] = {}
    for t in special:
        by_first.setdefault(t[0], []).append(t[1:])
    heads = []
    for first in sorted(by_first):
        rests = sorted(set(by_first[first]), key=lambda t: (-len(t), t))
        if "" in rests:  # a one-character token
            rests.remove("")
            body = "(?:" + "|".join(regex_escape(r) for r in rests) + ")?" if rests else ""
        else:
            body = "(?:" + "|".join(regex_escape(r) for r in rests) + ")"
        heads.append(regex_escape(first) + body)
    return "|".join(heads)


def token_pattern(special=SPECIAL_TOKENS) -> str:
    """Letter runs, digit runs, special tokens (atomic), any other single
    non-whitespace character.  Letters, digits and special tokens start with
    different characters, so only the last branch must follow the specials;
    the frequent branches go first."""
    other = "[^A-Za-z0-9" + WS_CLASS_BODY + "]"
    if not special:
        return "[A-Za-z]+|[0-9]+|" + other
    starts = {t[0] for t in special}
    if any(ch.isascii() and ch.isalnum() for ch in starts):
        # a special token starting with a letter or digit must be tried first
        return special_alternation(special) + "|[A-Za-z]+|[0-9]+|" + other
    return "[A-Za-z]+|[0-9]+|" + special_alternation(special) + "|" + other


def special_matches(c, tokens) -> Column:
    """Every occurrence of the listed tokens, in text order (one regex pass)."""
    return F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(special_alternation(tokens)), F.lit(0))


def tokenize(c, special=SPECIAL_TOKENS) -> Column:
    """H1: text -> array<string>; special tokens stay whole; no padding."""
    return F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(token_pattern(special)), F.lit(0))


def strip_tokens(c, tokens=REMOVE_TOKENS) -> Column:
    """Remove every listed token in one pass."""
    return F.regexp_replace(col_of(c), special_alternation(tokens), "")
