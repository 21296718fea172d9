"""Template windows and slots against a plain restatement; edge rows."""

import re
from collections import Counter, defaultdict

import duckdb

from corpusmill.llm import catalog
from corpusmill.llm import template_decontam as td

from ..conftest import SF_SMALL


HOLDERS = (td.NUMBER, td.UNIT, td.NAME)


def tokens(text):
    return re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[.!?\n]", text or "")


def words(text):
    """(template word, plain word, token, begins a sentence)."""
    tk, out = tokens(text), []
    for i, x in enumerate(tk):
        before = tk[i - 1] if i else None
        if x in td.MARKS:
            continue
        if x[0] in "0123456789":
            w = td.NUMBER
        elif x.lower() != x:
            w = td.NAME
        elif before and before[0] in "0123456789" and x in td.UNITS:
            w = td.UNIT
        else:
            w = x
        out.append((w, x.lower(), x, before is None or before in td.MARKS))
    return out


def windows(ws, width):
    return [ws[i:i + width] for i in range(max(1, len(ws) - width + 1))] if ws else []


def ordinary(docs, items):
    lower, name = Counter(), Counter()
    for _, text in [r for r in docs if r[0] is not None] + [r for r in dict.fromkeys(items) if None not in r]:
        tk = [t for t in tokens(text)]
        lower.update({x for x in tk if x[0].isalpha() and x.lower() == x})
        name.update({x.lower() for i, x in enumerate(tk) if x[0].isalpha() and x.lower() != x and i and tk[i - 1] not in td.MARKS})
    return {w for w in lower if lower[w] > name[w]}


def plain(docs, items):
    common, best = ordinary(docs, items), {}
    items = [r for r in dict.fromkeys(items) if None not in r]
    read = [(b, words(bt)) for b, bt in items]
    for d, dt in dict.fromkeys(docs):
        dw, by = words(dt), defaultdict(list)
        for p, v in enumerate(windows(dw, 5)):
            by[tuple(x[0] for x in v)].append((p, v))
        exacts = {n: {tuple(w[1] for w in x) for x in windows(dw, n)} for n in {min(len(bw), 5) for _, bw in read} - {0}}
        for b, bw in read:
            iw = windows(bw, 5)
            if d is None or not iw:
                continue
            exact = exacts[min(len(bw), 5)]
            literal = {i for i, w in enumerate(iw) if tuple(x[1] for x in w) in exact}
            found, changed = literal, 0
            if len(literal) < 0.8 * len(iw) and min(len(dw), len(bw)) >= 5:
                al = [(p - i, i, w, v) for i, w in enumerate(iw) for p, v in by[tuple(x[0] for x in w)]
                      if any(x[0] not in HOLDERS for x in w) and sum(x[0] not in (td.NUMBER, td.NAME) for x in w) >= td.LITERALS]
                slots = lambda w, v: [(x[0], x[2], y[2], x[3] or y[3]) for x, y in zip(w, v) if x[0] in HOLDERS]
                al = [(s, i, slots(w, v)) for s, i, w, v in al]
                al = [x for x in al if not any(t == td.NAME and first and f != g and {f.lower(), g.lower()} & common for t, f, g, first in x[2])]
                votes = defaultdict(Counter)
                for s, _, sl in al:
                    for t, f, g, _ in sl:
                        votes[s, t, f][g] += 1
                pick = {k: max(c.items(), key=lambda x: (x[1], x[0]))[0] for k, c in votes.items()}
                found = literal | {i for s, i, sl in al if all(pick[s, t, f] == g for t, f, g, _ in sl)}
                changed = len({(t, f) for (_, t, f), g in pick.items() if f != g})
            if len(found) >= 0.8 * len(iw):
                best[d, b] = max(best.get((d, b), (0,)), (len(found) / len(iw), len(iw), len(found), changed))
    return sorted((d, b, *v[1:]) for (d, b), v in best.items())


ITEM = "Tom has 5 apples and gives 2 to Anna near the old mill. How many apples are left after 3 days if Tom eats 5 kg?"
ROWS = [
    (1, "some words here. " + ITEM + " and more words after it"),
    (2, "intro. " + ITEM.replace("Tom", "Ben").replace("5", "9").replace("kg", "lb")),  # re-parameterised, consistent
    (3, "intro. Tom has 5 apples and gives 2 to Anna near the old mill. How many apples are left after 3 days if Max eats 8 kg?"),
    (4, "Tom has 5 pears. Nothing else of the question is here but a mill and 3 days."),
    (5, None), (6, ""), (7, "short text"), (8, "." * 50), (None, ITEM), (9, ITEM), (9, ITEM),
    (10, "intro. " + ITEM + " " + ITEM.replace("Tom", "Ben").replace("5", "7")),
]
ITEMS = [(1, ITEM), (2, "short text"), (3, None), (4, ""), (None, ITEM), (5, "unrelated question about the number of birds in a big tree")]


def frames(spark):
    return (spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, item_id string, pos int"),
            spark.createDataFrame([(*r, "y") for r in ITEMS], "item_id long, text string, doc_id string"))


def found(df):
    return sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_changed) for r in df.collect())


def test_equals_restatement(spark):
    docs, items = frames(spark)
    got = found(td.contaminated(docs, items))
    assert got == plain(ROWS, ITEMS)
    held = {(d, i): c for d, i, _, _, c in got}
    assert held[1, 1] == 0 and held[2, 1] > 0 and (7, 2) in held and (4, 1) not in held
    kept = td.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8, None} - {d for d, _ in held}


def test_slots_must_agree(spark):
    text = "a {0} b {0} c {0} d {0} e {0} f {0} g {0} h {0} i"
    item = [(1, text.format(4))]
    same, mixed = text.format(6), text
    for n in range(8):
        mixed = mixed.replace("{0}", str(n + 20), 1)
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    got = found(td.contaminated(docs, spark.createDataFrame(item, "item_id long, text string")))
    assert [(r[0], r[4]) for r in got] == [(1, 1)]


def test_short_items_are_found_behind_labels_and_quotes(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "How many legs does a spider have?")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Quiz. Q: What is the capital of France? A: Paris"), (2, 'They asked "How many legs does a spider have?" in class'),
        (3, "3) What is the capital of France? (b) Question: How many legs does a spider have?"),
        (4, "Lyon is a city of France and what has many legs is a spider")], "doc_id long, text string")
    assert [(d, i, c) for d, i, _, _, c in found(td.contaminated(docs, items))] == [(1, 1, 0), (2, 2, 0), (3, 1, 0), (3, 2, 0)]


def test_names_at_the_start_of_a_sentence(spark):
    item = "Tom has 3 apples. Mary has 4 apples. Bob has twice as many apples. How many apples do they have together?"
    items = spark.createDataFrame([(1, item), (2, "What is the capital of France?")], "item_id long, text string")
    other = item
    for a, b in (("Tom", "Ina"), ("Mary", "Carl"), ("Bob", "Eve"), ("3", "8"), ("4", "6")):
        other = other.replace(a, b)
    docs = spark.createDataFrame([(1, "Task. " + other + " Think."), (2, "They know what Paris is. Paris is the capital of France."),
                                  (3, other.replace("Eve", "Tim").replace("twice", "half").replace("together", "now").replace("has", "sold"))], "doc_id long, text string")
    assert [(d, i, c) for d, i, _, _, c in found(td.contaminated(docs, items))] == [(1, 1, 5)]


def test_items_below_the_width_are_found_inside_documents(spark):
    items = spark.createDataFrame([(1, "What is 7 + 5?"), (2, "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f"), (3, "Name three colours")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Some sums for today. Q: What is 7 + 5? A: 12"), (2, "\u95ee\u9898\uff1a\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f\u5317\u4eac\uff0c a b c d e"),
        (3, "Here the sum asked for what is 8 + 5 and no more, and name two colours"), (4, "Name three colours"), (5, "Call Three Colours")], "doc_id long, text string")
    assert found(td.contaminated(docs, items)) == [(1, 1, 1, 1, 0), (2, 2, 1, 1, 0), (4, 3, 1, 1, 0)]


def test_large_benchmarks_are_shuffled(spark, monkeypatch):
    docs, items = frames(spark)
    want = found(td.contaminated(docs, items))
    monkeypatch.setattr(td, "BROADCAST_MAX_BYTES", 0)
    assert found(td.contaminated(docs, items)) == want


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert td.contaminated(docs.limit(0), items).collect() == [] == td.contaminated(docs, items.limit(0)).collect()


def test_registered_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    clean = lambda row: tuple(None if x is None or x != x else x for x in row)
    for name, sql in catalog.ORACLE.items():
        got = catalog.QUERIES[name](spark, SF_SMALL)
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        assert columns == sorted(got.columns)
        at = [[c[0] for c in want.description].index(c) for c in columns]
        assert sorted((tuple(clean(r)[i] for i in at) for r in want.fetchall()), key=str) == sorted(
            map(clean, map(tuple, got.select(*columns).collect())), key=str), name


MANY = [ITEM, "What is the capital of France?", "How many legs does a spider have?", "What is 7 + 5?", "Name three colours",
        "Tom has 3 apples. Mary has 4 apples. Bob has twice as many apples. How many apples do they have together?",
        "1 2 3 4 5 6", "Who wrote Old Man And Sea Of Life", "the number of birds in a big tree is 5 km from the old mill"]


def varied(n):
    """Items behind labels, in quotes, re-parameterised, damaged, twice."""
    import random
    rng, out = random.Random(11), []
    for i in range(n):
        text = " ".join(rng.sample(MANY, rng.randint(0, 3)))
        for a, b in rng.sample([("Tom", "Ina"), ("Mary", "Carl"), ("Bob", "Eve"), ("3", "8"), ("4", "6"), ("5", "9"), ("How", "What"), ("France", "Spain"),
                                ("apples", "pears"), ("kg", "lb"), ("What", "Paris"), ("is", "IS"), ("old", "very old")], rng.randint(0, 4)):
            text = text.replace(a, b)
        text = rng.choice(["", "Q: ", "3) ", '"', "A long story. ", "the end "]) + text
        out.append((i if rng.random() < 0.9 else i // 2, text.upper() if rng.random() < 0.1 else text))
    return out


def test_all_readings_equal_restatement_and_sql(spark):
    rows, items = varied(150) + ROWS, [*enumerate(MANY), *[(100 + i, t) for i, t in ITEMS if i]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(rows, items)
    assert found(td.contaminated(docs, bench)) == want and any(r[4] for r in want)
    con = duckdb.connect()
    for name, data, cols in (("documents", rows, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({cols} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    got = con.execute(f"SELECT doc_id, item_id, n_windows, n_matched, n_changed FROM ({catalog.ORACLE['op1_template_decontam']})").fetchall()
    assert sorted(got) == want


def test_placeholders_are_no_evidence(spark):
    items = spark.createDataFrame([(1, "1 2 3 4 5 6"), (2, "Who wrote Old Man And Sea Of Life")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Table of sales: 10 20 30 40 50 60 70 80"), (2, "Tom wrote Harry Potter And Goblet Of Fire"),
                                  (3, "count: 1 2 3 4 5 6 7")], "doc_id long, text string")
    assert [(d, i) for d, i, *_ in found(td.contaminated(docs, items))] == [(3, 1)]


def test_texts_of_one_id_are_judged_one_by_one(spark):
    half = len(ITEM) // 2
    rows = [(1, ITEM), (1, "clean text of the same id"), (2, ITEM[:half]), (2, ITEM[half:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = td.drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted(rows[1:])


def test_very_long_text(spark):
    long = "word after Word 12 times. " * 60_000
    docs = spark.createDataFrame([(1, long), (2, long + "Q: " + ITEM)], "doc_id long, text string")
    got = found(td.contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")))
    assert [(d, i, c) for d, i, _, _, c in got] == [(2, 1, 0)]
