"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, ``://`` and identifier cues.  A deterministic parser for each anchor
expands it to the left and right and validates the span.  Per kind, spans are
leftmost and do not overlap; a span that fails its validation is dropped and
its characters are not tried again.

Kinds: email, ip, card, phone (the base), then
``userinfo``  user:password in front of the host of a url,
``iban``      after the cue IBAN, with its check digits,
``account``   6 to 18 digits after a cue such as account, konto, cuenta.

Defined results: null text is empty; empty text has no spans; repeated rows
are searched row by row; an empty table gives an empty table; only the key and
text columns are read by ``find_personal_data``, and ``redact`` passes other
columns through under their own names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import text_batches
from corpusmill.llm.spans import SPANS

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "userinfo", "iban", "account")
ORDER = {k: i for i, k in enumerate(KINDS)}

ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
IBAN = re.compile(r"[:\x20]{0,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number)\.?)?[\x20:#=]{0,3}([0-9]{6,18})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=1)  # once per Python worker
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("IBAN", "iban"), ("iban", "iban")):
        automaton.add_word(word, (kind, len(word)))
    for cue in ACCOUNT_CUES:
        for word in (cue, cue.capitalize(), cue.upper()):
            automaton.add_word(word, ("account", len(cue)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then in the order of ``KINDS``."""
    out: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # per kind: where the next span may start

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        done[kind] = end
        if valid:
            out.append((kind, start, end))

    for last, (anchor, size) in _anchors().iter(text):
        end = last + 1
        at = end - size
        if anchor == "digit":
            if at >= done["card"]:
                m = CARD.match(text, at)
                if m:
                    digits = "".join(DIGITS.findall(m[0]))
                    take("card", at, m.end(), 14 <= len(digits) <= 19 and luhn(digits))
                else:
                    done["card"] = end
            if at >= done["ip"]:
                m = IP.match(text, at)
                if m:
                    take("ip", at, m.end(), all(len(p) <= 3 and int(p) <= 255 for p in _ip_parts(m[0])))
                else:  # a later start in the same run of digits fails as well
                    done["ip"] = DIGITS.match(text, at).end()
        elif anchor == "at":
            start, low = at, done["email"]
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, end) if start < at else None
            if m:
                take("email", start, m.end())
        elif anchor == "plus":
            m = PHONE.match(text, at) if at >= done["phone"] else None
            if m:
                take("phone", at, m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15)
        elif anchor == "scheme":
            m = USERINFO.match(text, end) if end >= done["userinfo"] else None
            if m:
                take("userinfo", end, m.end())
        elif at == 0 or not text[at - 1].isalnum():
            m = (IBAN if anchor == "iban" else ACCOUNT).match(text, end)
            if m and m.start(1) >= done[anchor]:
                take(anchor, m.start(1), m.end(1), anchor == "account" or iban_valid(m[1]))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def _ip_parts(text: str) -> list[str]:
    return [p.lstrip("0") or "0" for p in text.split(".")]


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans array<struct<kind, start, end>>)`` for every row."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t)] if t else []
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, _arrow_spans())], ["key", "spans"])

    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)


def _arrow_spans() -> pa.DataType:
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def mask(text: str) -> str:
    """The text with every span replaced by ``[KIND]``; overlapping spans
    become one, named after the first."""
    parts, at = [], 0
    spans = find_spans(text)
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
        i += 1
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` masked; null stays null."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = pa.array([None if t is None else mask(t) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([masked if c == text else batch.column(c) for c in columns], columns)

    return text_batches(docs).mapInArrow(run, docs.schema)
