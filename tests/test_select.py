from pyspark.sql import functions as F

from corpusmill.operators.select import shortest_n, shortest_n_per_group
from corpusmill.plans.indexing import dense_index

ROWS = [(1, "bbb", "x"), (2, "a", "y"), (3, "cc", "x"), (4, None, "y"), (5, "a", "x")]


def _df(spark):
    return spark.createDataFrame(ROWS, "sample_id long, solution string, lang string")


def test_ties_and_null(spark):
    got = [r.sample_id for r in shortest_n(_df(spark), 3).collect()]
    assert sorted(got) == [2, 4, 5]  # null counts 0; tie on length 1 -> lower ids


def test_n_at_or_above_rows_and_zero(spark):
    for n in (5, 9, 0, None):
        assert shortest_n(_df(spark), n).count() == 5


def test_negative_n_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        shortest_n(_df(spark), -1)


def test_cut_equals_top_n(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("sample_id"),
                                     F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")).alias("solution"))
    for n in (1, 20, 21, 500, 1999):  # inside and at the end of a length
        got = {r.sample_id for r in shortest_n(df, n).collect()}
        assert got == {r.sample_id for r in df.orderBy(F.length("solution"), "sample_id").limit(n).collect()}


def test_per_group(spark):
    got = sorted((r.lang, r.sample_id) for r in shortest_n_per_group(_df(spark), 1, "lang").collect())
    assert got == [("x", 5), ("y", 4)]


def test_dense_index_is_exact(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("k"))
    for parts in (7, None):
        rows = dense_index(df, ["k"], "idx", num_partitions=parts).collect()
        assert sorted((r.k, r.idx) for r in rows) == [(i, i) for i in range(5000)]
    assert dense_index(df.limit(0), ["k"]).collect() == []


def test_kth_smallest_by_counting(spark, monkeypatch):
    """Numbers and strings; also when many passes are needed."""
    from corpusmill.operators import select
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001 - 1500).alias("n"))
    df = df.withColumn("s", F.concat(F.lit("k"), F.col("n").cast("string")))
    want = {c: sorted(r[0] for r in df.select(c).collect()) for c in ("n", "s")}
    for limit in (10_000, 50):
        monkeypatch.setattr(select, "KEYS_AT_ONCE", limit)
        for c in ("n", "s"):
            for k in (1, 777, 3000):
                assert select.kth_smallest(df.select(c), k, 3000) == want[c][k - 1]
    same = spark.range(0, 500).select(F.lit(4).alias("n"))  # keys that repeat without end
    assert select.kth_smallest(same, 300, 500) == 4


def test_selection_writes_nothing(spark, monkeypatch):
    from corpusmill.operators import select
    from corpusmill import session
    monkeypatch.setattr(session, "scratch_path", lambda *a: 1 / 0)
    monkeypatch.setattr(select, "KEYS_AT_ONCE", 20)
    df = spark.range(0, 2000).select(F.col("id").alias("sample_id"), F.repeat(F.lit("x"), (F.col("id") % 3).cast("int")).alias("solution"))
    got = {r.sample_id for r in shortest_n(df, 1000).collect()}
    assert got == {r.sample_id for r in df.orderBy(F.length("solution"), "sample_id").limit(1000).collect()}
