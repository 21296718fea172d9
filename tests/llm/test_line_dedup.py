"""Line dedup against brute force; edge rows."""

import hashlib
import random
from collections import defaultdict

from corpusmill.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, min_chars=1):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    docs = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                docs[key(line)].add(d)
    gone = {k for k, ids in docs.items() if len(ids) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(spark, rows, least, **more):
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, kept string, pos int")
    out = line_dedup.drop_lines(docs, min_documents=least, **more)
    assert out.columns == ["doc_id", "text", "pos", "kept", "n_lines", "n_dropped"]
    back = out.collect()
    assert sorted(r.pos for r in back) == list(range(len(rows))) and all(rows[r.pos] == (r.doc_id, r.text) for r in back)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in back), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    lines = ["Home", "  home\t", "HOME \r", "École", "école", "", "   ", "a b", "a  b", " x", "long " * 30, "K", "K", *map(str, range(40))]
    rows = [(rng.choice([i, i, i, None, 3]), "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "Home"), (203, "Home"), (204, "home\nhome\nonly here")]
    for least in (1, 2, 10, 40):
        assert got(spark, rows, least) == plain(rows, least)
    assert got(spark, rows, 10, min_chars=3) == plain(rows, 10, 3)


def test_rows_of_one_document_count_once(spark):
    rows = [(1, f"same\n{i}") for i in range(12)]
    assert all(n == 0 for _, _, n, _ in got(spark, rows, 2))
    assert all(n == 1 for _, _, n, _ in got(spark, [*rows, (2, "SAME"), (None, " same")], 2))


def test_long_text_and_large_key_set(spark, monkeypatch):
    text = "\n".join(f"line {i % 7000}" for i in range(60_000))
    rows = [(i, text + f"\nown {i}") for i in range(3)] + [(9, "line 1")]
    want = plain(rows, 3)
    assert got(spark, rows, 3) == want
    monkeypatch.setattr(line_dedup, "small_side", lambda df: df)  # the way beyond a broadcast
    assert got(spark, rows, 3) == want


def test_replaces_the_text_and_takes_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    out = line_dedup.drop_lines(docs, min_documents=2, kept="text")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "b"), (2, "")]
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_digest_of_the_query_is_of_the_kept_text(spark):
    from corpusmill.llm import catalog

    from ..conftest import SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(rows, 10))
    assert sorted(map(tuple, catalog.QUERIES["op11_line_dedup"](spark, SF_SMALL).collect())) == want
    assert any(k for _, _, k, _ in want)
