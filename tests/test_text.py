import random

from pyspark.sql import functions as F

from corpusmill.functions.text import WS, regex_escape, split_sentences, strip


def test_strip_matches_python(spark):
    rnd = random.Random(7)
    pool = list(WS) + list("ab céあ")
    rows = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", strip("s").alias("t")).collect()}
    assert got == {i: r.strip() for i, r in enumerate(rows)}


def test_split_sentences_edges(spark):
    cases = {"A. B! C?": 3, "x=3.14 ok.": 1, "...": 1, "A.B.": 1, "": 0, "  One.　Two. ": 2}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.n for r in df.select("s", F.size(split_sentences("s")).alias("n")).collect()}
    assert got == cases


def test_regex_escape_literal(spark):
    tok = "<|im_end|>"
    df = spark.createDataFrame([("a<|im_end|>b",)], "s string")
    assert df.select(F.regexp_replace("s", regex_escape(tok), "").alias("x")).first().x == "ab"


def test_ws_class_is_exactly_the_strip_set(spark):
    from corpusmill.functions.text import WS_CLASS
    cps = [cp for cp in range(1, 0x3100) if not 0xD800 <= cp <= 0xDFFF]
    df = spark.createDataFrame([(cp, chr(cp)) for cp in cps], "cp int, ch string")
    got = {r.cp for r in df.filter(F.regexp_like("ch", F.lit("^" + WS_CLASS + "$"))).collect()}
    assert got == {ord(c) for c in WS}


def test_split_sentences_random_matches_python(spark):
    import re
    rnd = random.Random(21)
    pool = list(".!?") + list(WS) + list("abc가") + [". ", "! ", "?\n"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) for _ in range(500)]

    def py(t):
        return [p.strip() for p in re.split(r"[.!?]+\s+", t.strip()) if p.strip()]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.s) for r in df.select("i", split_sentences("t").alias("s")).collect()}
    assert got == {i: py(t) for i, t in enumerate(texts)}
