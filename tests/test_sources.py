import os

import pytest

from corpusmill.sources.datasets import output_filename, read_dataset, sanitize_name, sanitize_name_py, write_dataset
from corpusmill.sources.jsonl import read_jsonl, write_jsonl

SCHEMA = "id long, s string"


def _write(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.jsonl"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def test_read_modes(spark, tmp_dir):
    path = _local(tmp_dir)
    _write(path, ['{"id": 1, "s": "a"}', "", "   ", "{bad", '[{"id": 2}, {"id": 3}]', "5", '{"id": 4, "s": null}'])
    good, bad = read_jsonl(spark, path, SCHEMA, mode="report")
    assert sorted((r.id, r.s) for r in good.collect()) == [(1, "a"), (4, None)]
    assert sorted(r.value for r in bad.collect()) == ["5", "[{\"id\": 2}, {\"id\": 3}]", "{bad"]
    with pytest.raises(Exception, match="invalid JSON line"):
        read_jsonl(spark, path, SCHEMA, mode="strict").count()


def test_missing_file_fails(spark):
    with pytest.raises(Exception):
        read_jsonl(spark, "/nonexistent/corpusmill/x.jsonl", SCHEMA)


def test_write_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "한국어"), (2, None), (3, 'q"uote\nline')], SCHEMA)
    write_jsonl(df, tmp_dir)
    raw = "".join(open(os.path.join(_local(tmp_dir), f), encoding="utf-8").read()
                  for f in os.listdir(_local(tmp_dir)) if f.startswith("part-"))
    assert "한국어" in raw and '"s":null' in raw
    back = read_jsonl(spark, tmp_dir, SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())


def test_sanitize(spark):
    cases = {"/a/b<c>:__d": "a_b_c_d", "___": "", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.x for r in df.select("n", sanitize_name("n").alias("x")).collect()} == cases
    assert all(sanitize_name_py(k) == v for k, v in cases.items())
    assert output_filename("org/set", "train", None, 5, "original") == "original_org_set_train_5.jsonl"
    assert output_filename("org/set", "test", "sub", 7) == "org_set_test_sub_7.jsonl"


def test_dataset_subset_and_split(spark, tmp_dir):
    df = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "en")], "id long, lang string")
    write_dataset(df, tmp_dir, "org/data", subset_col="lang")
    assert sorted(r.id for r in read_dataset(spark, tmp_dir, "org/data", subset="en").collect()) == [1, 3]
    assert read_dataset(spark, tmp_dir, "org/data").count() == 3
    for wrong in ({"split": "test"}, {"subset": "de"}, {"subset": "en", "split": "test"}):
        with pytest.raises(ValueError):
            read_dataset(spark, tmp_dir, "org/data", **wrong)


def test_dataset_without_folders(spark, tmp_dir):
    df = spark.createDataFrame([(1, "mine")], "id long, subset string")
    df.write.parquet(f"{tmp_dir}/plain")
    with pytest.raises(ValueError):
        read_dataset(spark, tmp_dir, "plain")
    assert read_dataset(spark, tmp_dir, "plain", split=None).collect() == df.collect()  # its own column stays
    write_dataset(df, tmp_dir, "split-only")
    assert read_dataset(spark, tmp_dir, "split-only").first().subset == "mine"
    with pytest.raises(ValueError):
        read_dataset(spark, tmp_dir, "split-only", subset="mine")


def test_lines_as_the_standard_loader_reads_them(spark, tmp_dir):
    lines = ['{"id": 1, "id": 2, "x": NaN}', '{"id": 3, "x": 1.5, "more": [1]}', '{"id": "text", "x": 1}', '{"id": 4} {"id": 5}',
             '{"id": 6}, {"id": 7}', "{'id': 8}", '{"id": 9, "x": Infinity}', ' {"id": 10}', '{"id": 11} x', '{}']
    _write(_local(tmp_dir), lines)
    good, bad = read_jsonl(spark, _local(tmp_dir), "id long, x double", mode="report")
    assert sorted((r.id or 0, str(r.x)) for r in good.collect()) == [(0, "None"), (2, "nan"), (3, "1.5"), (9, "inf"), (10, "None")]
    assert sorted(r.value for r in bad.collect()) == sorted(lines[i] for i in (2, 3, 4, 5, 8))


def test_dataset_json_format(spark, tmp_dir):
    df = spark.createDataFrame([(1, "en"), (2, "fr")], "id long, lang string")
    write_dataset(df, tmp_dir, "d", subset_col="lang", fmt="json")
    assert sorted(r.id for r in read_dataset(spark, tmp_dir, "d", subset="fr", fmt="json").collect()) == [2]


def test_sanitize_random_matches_python(spark):
    import random
    rnd = random.Random(13)
    pool = list('/<>:"|?*_ab.é')
    names = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: r.x for r in df.select("i", sanitize_name("n").alias("x")).collect()}
    assert got == {i: sanitize_name_py(n) for i, n in enumerate(names)}


def test_bad_lines_are_numbered_over_several_splits(spark, tmp_path):
    import json
    import re

    import pytest

    from corpusmill.sources.jsonl import read_jsonl
    bad = {7, 1500, 2999, 3000}
    for name in ("a", "b"):
        lines = ["{broken" if i in bad and name == "b" else "" if i % 100 == 50 else json.dumps({"x": i, "t": "y" * (i % 90)}) for i in range(1, 3001)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows, found = read_jsonl(spark, str(tmp_path), "x long, t string", mode="report")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.file[-7:], r.line, r.value) for r in found.collect()) == [("b.jsonl", i, "{broken") for i in sorted(bad)]
        assert rows.count() == 2 * 3000 - 4 - 2 * 30 + sum(i % 100 == 50 for i in bad)
        with pytest.raises(Exception, match=r"b\.jsonl line \d+: \{broken") as caught:
            read_jsonl(spark, str(tmp_path), "x long, t string").count()
        assert int(re.search(r"line (\d+): \{broken", str(caught.value)).group(1)) in bad
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_strict_read_parses_a_line_once(spark, tmp_dir):
    from corpusmill.sources.jsonl import read_jsonl
    spark.createDataFrame([('{"a": 1, "b": "x"}',), (" ",), ('{"a": null, "b": "y"}',)], "value string").coalesce(1).write.text(tmp_dir + "/once")
    df = read_jsonl(spark, tmp_dir + "/once", "a long, b string")
    assert sorted(df.collect(), key=lambda r: r.b) == [(1, "x"), (None, "y")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(_bad_line") == 1  # one parse by the schema, for the test and the row
