"""Language identification: held-out accuracy and edge rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import language_id as lid

from ..conftest import SF_SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = lid.fit(docs, per_language=40)
    got = lid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", lid.held_out(F.col("doc_id"))).collect()
    assert {r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got} == {True}
    held = [r for r in got if r.held]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_hierarchy():
    rng = np.random.default_rng(1)
    words = {"en": "the and of to", "de": "der die und nicht", "fr": "le la et est", "es": "el los que para", "xx": "zzq wwk qqx"}
    texts = [(lang, " ".join(rng.choice(w.split(), 30))) for lang, w in words.items() for _ in range(20)]
    model = lid.LanguageModel.fit(np.array([lid.counts(t) for _, t in texts]), np.array([x for x, _ in texts], dtype=object))
    assert model.families.names == ["germanic", "romance", "xx"]
    assert {f: c.names for f, c in model.languages.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert all(model.predict(t)[0] == lang for lang, t in texts)
    assert model.predict("12 #3")[0] == "und" == model.predict(None)[0] == model.predict("")[0]


def test_counts_of_long_texts_do_not_depend_on_the_block():
    text = "abc é def " * 250_000
    assert np.allclose(lid.counts(text), lid.counts(text[:len(text) // 2]), atol=1e-4)


ROWS = [(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (4, "", "de"), (5, "1234 !", "en"), (6, "the of", None),
        (None, "der und", "de"), (7, "the and of", "en"), (7, "the and of", "en")]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in ROWS], "doc_id long, text string, lang string, key string, score double")
    model = lid.fit(df)
    got = lid.predict(df, model).collect()
    assert len(got) == len(ROWS)
    und = {3, 4, 5}
    assert all((r.lang_pred == "und") == (r.doc_id in und) for r in got)
    kept = lid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(ROWS) - len(und)
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lid.predict(df, lid.fit(unlabelled)).collect()} == {"und"}
    assert lid.predict(df.limit(0), lid.fit(df.limit(0))).collect() == []


def test_repeated_ids_do_not_crowd_out_a_language(spark):
    rows = [(4, f"the and of number {i}", "en") for i in range(300)] + [(100 + i, f"der die das und {i}", "de") for i in range(20)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=20)
    assert model.languages["germanic"].names == ["de", "en"]


def test_sample_is_bounded_per_language(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lid.LanguageModel, "fit", classmethod(lambda cls, x, langs: seen.update(zip(*np.unique(langs, return_counts=True)))))
    rows = [(i, f"the and of {i % 1500}", "en") for i in range(3000)] + [(i, f"der {i}", "de") for i in range(5)] + [(1, "same text", "fr")] * 500
    lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50)
    assert seen["en"] == 50 and seen["fr"] == 1 and 1 <= seen["de"] <= 5


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    wrong = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    a, b = (sorted(map(tuple, lid.predict(x, lid.fit(x, per_language=30)).collect())) for x in (docs, wrong))
    assert a == b


def test_predictions_equal_restatement(spark):
    """Features counted one by one; votes over all pairs, family first."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = lid.fit(docs, per_language=30)

    def features(text):
        data = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in text.lower().encode())
        v = [0.0] * lid.DIMENSIONS
        for n in (1, 2, 3):
            for i in range(len(data) - n + 1):
                h = int.from_bytes(data[i:i + n], "big") * 0x9E3779B1 + n * 0x85EBCA6B
                v[(h & 0xFFFFFFFF) >> 20] += 1
        size = sum(x * x for x in v) ** 0.5
        return np.array([x / size for x in v])

    def choose(choice, v):
        if len(choice.names) == 1:
            return choice.names[0], 1.0
        votes, sums, sure = ({n: z for n in choice.names} for z in (0, 0.0, 1.0))
        for (a, b), w in zip(choice.pairs, choice.weights.T):
            a, b, m = choice.names[a], choice.names[b], float(v @ w)
            votes[a if m >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            sure[a], sure[b] = min(sure[a], 1 / (1 + np.exp(-3 * m))), min(sure[b], 1 / (1 + np.exp(3 * m)))
        best = max(choice.names, key=lambda n: (votes[n], sums[n]))
        return best, sure[best]

    got = {r.doc_id: r for r in lid.predict(docs, model).collect()}
    for r in docs.where("length(text) < 3000").limit(80).collect():
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        v = features(r.text)
        family, p = choose(model.families, v)
        lang, q = choose(model.languages[family], v)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - p * q) < 1e-6


def test_stage_fills_and_rejects(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the and of to", "en")] * 30 + [("the of and", None), ("der und die", None), ("?", "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in lid.keep_identified(docs).collect()}
    assert kept[60] == "en" and kept[61] == "de" and 62 not in kept and len(kept) == 62
    assert lid.keep_identified(docs, least=1.01).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "the and of to " * 200_000, "en"), (2, "der die das und " * 30, "de"), (5, "the and of", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in lid.predict(docs, lid.fit(docs)).collect()}[1] == "en"
