"""Hierarchical language identification.

First the language family, then the language within it; on both levels linear
support vector machines decide one against one and the most votes win (ties:
the larger sum of margins).  Features are hashed counts of byte 1-, 2- and
3-grams of the lower-cased letters, scaled to length 1.

The machines are fitted on a bounded sample: per language the
``min(per_language, sample_rows / languages)``, at least 1, distinct labelled
documents that come first by a hash of id and text.  A threshold of that hash,
taken from the counts per language, is applied before anything is shuffled, so
neither a frequent language nor a repeated id meets in one task, and no language
can crowd out another.  Prediction reads every text whole, of any length, and
uses nothing but the text.

Defined results: null text, or one without a letter, is ``und`` with score 0;
without labelled rows everything is ``und``; with one language every other
text has that language, score 1; repeated rows are predicted row by row; a
null id is not held out; an empty table gives an empty table; only the id,
text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spill_table, text_batches

DIMENSIONS = 4096
PER_LANGUAGE = 1000
SAMPLE_ROWS = 20_000
# a winner of both levels scores 0.25 or more; the pipeline rejects what is near a tie on both
MIN_SCORE = 0.3
FAMILY_ROWS = 4000  # of the sample, at most so many fit one machine between families

# families of languages; a language not listed here is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

# ASCII characters other than letters become spaces; other bytes stay
_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, scaled to length 1."""
    data = text.lower().encode().translate(_LETTERS)
    total = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(data), 1 << 20):  # bounded memory for very long texts
        b = np.frombuffer(data[max(0, at - 2):at + (1 << 20)], np.uint8).astype(np.uint32)
        new = b[2:] if at else b
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        if at:
            two = two[1:]
        for salt, grams in ((1, new), (2, two), (3, three)):
            total += np.bincount((grams * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20), minlength=DIMENSIONS)
    size = np.sqrt(total @ total)
    return total / size if size else total


def fit_machine(x: np.ndarray, y: np.ndarray, weight_decay: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Linear support vector machine with squared hinge loss (accelerated
    gradient steps); y is +1 or -1, both classes weigh the same."""
    # single precision and one copy of the rows: the driver's memory is small
    n_plus = max(1, int((y > 0).sum()))
    share = np.where(y > 0, 0.5 / n_plus, 0.5 / max(1, len(y) - n_plus)).astype(np.float32)
    z = x.astype(np.float32)
    z *= y.astype(np.float32)[:, None]
    u = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), np.float32)
    for _ in range(20):  # largest curvature
        u = z.T @ (share * (z @ u))
        u /= np.linalg.norm(u) or np.float32(1)
    step = 1 / (weight_decay + 2 * float(u @ (z.T @ (share * (z @ u)))) + 1e-12)
    w = v = np.zeros(z.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - z @ v)
        new = v - step * (weight_decay * v - 2 * (z.T @ (share * slack)))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w.astype(np.float64)


@dataclass
class Choice:
    """One-against-one machines between ``names``."""
    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS, 0)))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, rows: int | None = None) -> Choice:
        names = sorted(set(labels))
        pairs, weights = list(combinations(range(len(names)), 2)), []
        for a, b in pairs:
            at = np.nonzero((labels == names[a]) | (labels == names[b]))[0]
            if rows and len(at) > rows:
                at = at[np.linspace(0, len(at) - 1, rows).astype(int)]  # every k-th of the sample
            weights.append(fit_machine(x[at], np.where(labels[at] == names[a], 1.0, -1.0)))
        return cls(names, pairs, np.array(weights).T if weights else np.zeros((DIMENSIONS, 0)))

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        """The winner and its confidence: the least probability it has against
        another name."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = v @ self.weights
        votes, sums, least = (np.zeros(len(self.names)) for _ in range(3))
        least += 1
        for (a, b), m in zip(self.pairs, margins):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            p = 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(range(len(self.names)), key=lambda i: (votes[i], sums[i]))
        return self.names[best], float(least[best])


@dataclass
class LanguageModel:
    families: Choice
    languages: dict[str, Choice]

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> LanguageModel:
        family = np.array([family_of(lang) for lang in langs], dtype=object)
        return cls(Choice.fit(x, family, FAMILY_ROWS), {f: Choice.fit(x[family == f], langs[family == f]) for f in sorted(set(family))})

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.languages:
            return "und", 0.0
        v = counts(text)
        family, p = self.families.decide(v)
        lang, q = self.languages[family].decide(v)
        return lang, p * q


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from the labelled rows that are not held out (bounded sample)."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    named = labelled.select(F.xxhash64(key, text).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    languages = spill_table(named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "lid-languages")
    each = max(1, min(per_language, sample_rows // max(1, languages.count())))
    # about 4 times as many as wanted pass (of few documents all do), exactly ``each`` of them are taken
    share = F.col("n") / F.lit(4.0 * each + 64)
    passed = named.select("lang", "h").join(F.broadcast(languages), "lang").where((share <= 1) | (F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) / share))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = spill_table(passed.select("lang", "h").distinct().withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= each).select("lang", "h"), "lid-sample")
    # at most ``each`` per language: a proven bound, also of what reaches the driver
    rows = named.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, name, t in zip(*(batch.column(c).to_pylist() for c in ("h", "lang", "text"))):
                if has_letter(t):
                    v = counts(t)
                    at = np.nonzero(v)[0].astype(np.int16)
                    found.append((k, name, at.tobytes(), v[at].astype(np.float32).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*found), (pa.int64(), pa.string(), pa.binary(), pa.binary()))], ["h", "lang", "at", "value"])

    sample = text_batches(rows.select("h", "lang", "text")).mapInArrow(run, "h long, lang string, at binary, value binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["h"], r["lang"]))
    x = np.zeros((len(sample), DIMENSIONS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["value"], np.float32)
    return LanguageModel.fit(x, np.array([r["lang"] for r in sample], dtype=object))


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` of every row."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], ["key", "lang_pred", "score"])

    light = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return text_batches(light).mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those whose language cannot be told: ``und``, or a
    prediction with a score below ``least``.  A null language is filled with
    the predicted one; a given one stays."""
    model, columns = fit(docs, key, text, lang), docs.columns
    at, named = columns.index(text), columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [model.predict(t.as_py()) for t in batch.column(at)]
            given = batch.column(named)
            filled = [old.as_py() if old.is_valid else new for old, (new, _) in zip(given, told)]
            out = batch.set_column(named, batch.schema.field(named), pa.array(filled, given.type))
            yield out.filter(pa.array([new != "und" and score >= least for new, score in told], pa.bool_()))

    return text_batches(docs).mapInArrow(run, docs.schema)
