"""Personal data and secrets against the plain patterns."""

import hashlib
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from corpusmill.llm import pii_anchors as pii
from corpusmill.llm import secret_ledger as ledger
from corpusmill.llm.spans import span_columns
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        out += [("card", *m.span())] * (14 <= len(d) <= 19 and s % 10 == 0)
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.ORDER[s[0]]))


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "+", "1", "23", "255", ".", "-", " ", "(", ")", "4242424242424242", "é", "٣", "x@y.z",
                                 "10.0.0.1", "+1 (415) 555-0100", "://", "u:p@", "\n"]), max_size=25).map("".join))
@example("a@b.c@d.e")
@example("1.2.3.4.5.6.7.8 001.2.3.4")
def test_base_spans_equal_patterns(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain_pii(text)


def test_other_kinds_and_mask():
    text = "IBAN DE89 3704 0044 0532 0130 00, ftp://me:pw@host/x, Konto: 12345678; recount 99"
    kinds = {k: text[a:b] for k, a, b in pii.find_spans(text)}
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["userinfo"] == "me:pw" and kinds["account"] == "12345678"
    assert pii.mask("x 10.0.0.1 y a@b.co") == "x [IP] y [EMAIL]"
    assert pii.mask("clean text") == "clean text"


ROWS = [(1, "mail a@b.co +1 (415) 555-0100"), (2, None), (3, ""), (4, "4242 4242 4242 4242"), (4, "4242 4242 4242 4242"), (None, "1.2.3.4")]


def test_table_form(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, spans string")
    got = pii.find_personal_data(df).select("doc_id", *span_columns(F.col("spans"), pii.BASE_KINDS)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(
        (str(i), *(sum(s[0] == k for s in plain_pii(t or "")) for k in pii.BASE_KINDS),
         sha(",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(t or "")))) for i, t in ROWS)
    masked = {r.text for r in pii.redact(df).collect()}
    assert masked == {"mail [EMAIL] [PHONE]", None, "", "[CARD]", "[IP]"}
    assert pii.find_personal_data(df.limit(0)).collect() == [] == pii.redact(df.limit(0)).collect()


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ledger.BASE_KINDS.index(s[0])))


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(["Password", "api_key", "APIKEY", "toKen", "secret", "Key", "=", ":", " ", '"', "abc123", "x", "AKIA",
                                 "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "\n", "ſecret"]), max_size=14).map("".join))
def test_rules_equal_patterns(text):
    got = [(r.kind, a, b) for r in ledger.RULES for a, b in r.spans(text) if r.kind in ledger.BASE_KINDS]
    assert sorted(got, key=lambda s: (s[1], ledger.BASE_KINDS.index(s[0]))) == plain_secrets(text)


def test_ledger_is_incremental(spark, tmp_dir):
    rows = [(1, "token = abcdef1"), (2, "token = abcdef1"), (3, None), (4, ""), (None, "AKIA" + "A" * 16)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, blob string")
    first = ledger.scan_versions(df, tmp_dir, rules=ledger.RULES[:1])
    assert sorted((str(r.doc_id), len(r.findings)) for r in first.collect()) == [("1", 1), ("2", 1), ("3", 0), ("4", 0), ("None", 0)]
    assert ledger.read_ledger(spark, tmp_dir).count() == 3  # distinct blobs
    again = ledger.scan_versions(df, tmp_dir, rules=ledger.RULES[:1])
    assert ledger.read_ledger(spark, tmp_dir).count() == 3 and again.count() == 5  # nothing scanned again
    more = spark.createDataFrame([(5, "secret: zzzzzz"), (6, "token = abcdef1")], "doc_id long, text string")
    got = ledger.scan_versions(more, tmp_dir, rules=ledger.RULES[:2])
    assert {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in got.collect()} == {
        5: [("assign", 0, 14)], 6: [("assign", 0, 15)]}
    entries = ledger.read_ledger(spark, tmp_dir).collect()
    assert len(entries) == 5 and sorted(e.rules for e in entries[:])[0] == ["access@1"]  # an old blob, the new rule only
    newer = (ledger.Rule("assign", 2, r"token = [a-z]+"),)
    got = ledger.scan_versions(more, tmp_dir, rules=newer)
    assert {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in got.collect()} == {5: [], 6: [("assign", 0, 14)]}
    assert ledger.scan_versions(df.limit(0), tmp_dir).collect() == []


def test_entries_made_twice_count_once(spark, tmp_dir):
    df = spark.createDataFrame([(1, "token = abcdef1 AKIA" + "A" * 16)], "doc_id long, text string")
    ledger.scan_versions(df, tmp_dir)
    rows = ledger.read_ledger(spark, tmp_dir).collect()
    spark.createDataFrame(rows, ledger.LEDGER).write.mode("append").parquet(tmp_dir)  # another run at the same time
    assert [(f.kind, f.start) for f in ledger.scan_versions(df, tmp_dir).first().findings] == [("assign", 0), ("access", 16)]


def test_known_texts_are_not_shuffled(spark, tmp_dir, monkeypatch):
    """The second run's texts: only those of unseen blobs reach the scan."""
    old = spark.range(300).selectExpr("id AS doc_id", "concat('token = abcdef', id, repeat(' x', 3000)) AS text")
    ledger.scan_versions(old, tmp_dir)
    scanned = []
    real = ledger._scan
    monkeypatch.setattr(ledger, "_scan", lambda todo, rules: (scanned.append(todo), real(todo, rules))[1])
    new = old.unionByName(spark.createDataFrame([(999, "secret: abcdefg")], "doc_id long, text string"))
    got = ledger.scan_versions(new, tmp_dir).where("size(findings) = 1").count()
    assert got == 301
    plan = scanned[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and ledger.read_ledger(spark, tmp_dir).count() == 301


def test_linear_time_on_hostile_texts():
    import time
    n = 1 << 20
    texts = ["eyJ" * (n // 3), "eyJabcdefgh." * (n // 12), "token" * (n // 5), "token:" + " " * n, "AKIA" * (n // 4), "deadbeef " * (n // 9),
             "-----BEGIN " * (n // 11), "0123456789abcdef0123456" * (n // 23), "a@" * (n // 2), "+1 " * (n // 3), "1." * (n // 2), "1 " * (n // 2), "http://" * (n // 7)]
    start = time.time()
    for text in texts:
        for rule in ledger.RULES:
            rule.spans(text)
    assert time.time() - start < 60
    start = time.time()
    for text in texts:
        pii.find_spans(text)
    assert time.time() - start < 120
