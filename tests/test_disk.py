"""What a job keeps on disk, and that keeping less gives the same rows."""

import gzip
import os
import time

import corpusmill.plans.source_queries as source_queries
import corpusmill.sources.jsonl as jsonl
from corpusmill.functions.text import WS
from corpusmill.operators.lexicon import rewrite_text
from corpusmill.operators.rewrite import run_rewrite
from corpusmill.plans.fixtures import view
from corpusmill.plans.rewrite_queries import lexicon_mapping
from corpusmill.session import ScratchParts, scratch_scope, shuffles_dropped
from corpusmill.sources.jsonl import read_jsonl, write_jsonl
from tests.scripted import ScriptedTransformer

SCHEMA = "id long, s string"


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def _shuffles_gone(spark, before):
    """Whether, after a while, no shuffle file is there that was not before."""
    for _ in range(100):
        if _shuffle_files(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def _paired(spark, sf, root, monkeypatch, parts):
    """The rows of paired_sinks made in so many parts, with what stays on disk."""
    monkeypatch.setattr(source_queries, "PART_BYTES", 1 if parts > 1 else 1 << 40)
    monkeypatch.setattr(source_queries, "MAX_PARTS", parts)
    dropped = []
    drop = ScratchParts.drop
    with monkeypatch.context() as m:
        m.setattr(source_queries, "scratch_path", lambda _, name: f"{root}/{name}")
        m.setattr("corpusmill.session.checkpoint_root", lambda _: f"{root}/scratch")
        m.setattr(ScratchParts, "drop", lambda self, at: (dropped.append(at), drop(self, at)))
        before = _shuffle_files(spark)
        out = source_queries.q_paired_sinks(spark, sf)
        assert _shuffles_gone(spark, before)
    assert dropped == list(range(parts)) and not _files(f"{root}/scratch")
    return sorted(map(tuple, out.collect()), key=repr)


def test_paired_sinks_keeps_packed_files_and_nothing_else(spark, tmp_path, monkeypatch):
    text = "The function of 정수 is long. A prime number, and the equation 'x = {}' holds!\n" * 30
    ids = [*range(40), 5, 5, 22, 22]  # rows that repeat an id meet all rewrites of it
    rows = [(i, text.replace("{}", str(i)) if i % 9 else " \n" if i % 2 else None, "en", f"src{i % 3}", 9) for i in ids]
    sf = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    whole = _paired(spark, sf, str(tmp_path / "whole"), monkeypatch, 1)
    assert _paired(spark, sf, str(tmp_path / "parts"), monkeypatch, 4) == whole

    samples = [r.asDict() for r in view(spark, sf, "samples").collect()]
    lexicon = lexicon_mapping(spark, sf)
    stripped = {r["sample_id"]: (r["solution"] or "").strip(WS) for r in samples}
    expected = {("original", r["sample_id"], r["question"], r["solution"], r["answer"]) for r in samples}
    for r in samples:
        i = r["sample_id"]
        expected.add(("code_switched", i, r["question"] or "", rewrite_text(stripped[i], lexicon), r["answer"] or "") if stripped[i] else
                     ("code_switched", i, r["question"], r["solution"], r["answer"]))
    assert set(whole) == expected
    for run in ("whole", "parts"):
        paired = tmp_path / run / "paired"
        names = sorted(os.listdir(paired))
        assert names == ["attempt_log", f"code_switched_documents_train_{len(ids)}.jsonl", f"original_documents_train_{len(ids)}.jsonl"]
        plain = sum(len(r.line.encode()) for r in view(spark, sf, "samples").selectExpr("to_json(struct(*)) AS line").collect())
        assert sum(os.stat(paired / names[2] / f).st_size for f in os.listdir(paired / names[2])) < plain / 2
        assert "_SUCCESS" in os.listdir(paired / names[1])


def test_shuffles_of_a_query_go_with_it(spark, tmp_dir):
    before = _shuffle_files(spark)
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").write.parquet(tmp_dir)
    assert _shuffles_gone(spark, before) and spark.read.parquet(tmp_dir).count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_calls_to_make_go_after_the_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusmill.session.checkpoint_root", lambda _: str(tmp_path / "scratch"))
    df = spark.createDataFrame([(i, "long enough text") for i in range(30)] + [(7, "another text")], "sample_id long, solution string")
    rows = sorted(run_rewrite(df, ScriptedTransformer({}), str(tmp_path / "log"), task_rows=5).collect())
    assert not _files(tmp_path / "scratch")
    df.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(run_rewrite(stored, ScriptedTransformer({}), str(tmp_path / "again"), task_rows=5, stored=True).collect()) == rows


def test_packed_lines_are_the_same_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "PACKED_ROWS", 40)
    df = spark.createDataFrame([(i, "한국어 " * (i % 5) if i % 4 else None) for i in range(100)], SCHEMA).coalesce(1)
    write_jsonl(df, str(tmp_path / "plain"))
    seen = []

    def several():
        for low in (0, 50, 200):  # the last holds no row
            yield df.filter(f"id >= {low} AND id < {low + 50}")
            seen.append("_SUCCESS" in os.listdir(tmp_path / "packed"))

    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "part-old.json").write_text('{"id": -1, "s": "replaced"}\n')
    write_jsonl(several(), str(tmp_path / "packed"), compression="gzip")
    assert seen == [False] * 3 and "_SUCCESS" in os.listdir(tmp_path / "packed")  # complete after the last
    packed = [gzip.open(tmp_path / "packed" / f, "rt", encoding="utf-8").read().splitlines() for f in _files(tmp_path / "packed") if f.endswith(".json.gz")]
    plain = [x for f in _files(tmp_path / "plain") if f.endswith(".json") for x in (tmp_path / "plain" / f).read_text().splitlines()]
    assert sorted(sum(packed, [])) == sorted(plain) and max(map(len, packed)) == 40
    assert sorted(read_jsonl(spark, str(tmp_path / "packed"), SCHEMA).collect(), key=repr) == sorted(df.collect(), key=repr)


def test_parts_of_the_keys(spark):
    rows = [(i % 20, f"t{i}") for i in range(60)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "id long, s string")
    with scratch_scope(spark):
        kept = ScratchParts(df, "some", "id", 4)
        assert kept.table().schema == df.schema and sorted(kept.table().collect(), key=repr) == sorted(df.collect(), key=repr)
        parts = [kept.part(i).collect() for i in range(4)]
        assert sorted(sum(parts, []), key=repr) == sorted(df.collect(), key=repr) and all(parts)
        keys = [{r.id for r in p} for p in parts]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 21  # a key, and null, in one part only
        assert [{r.id for r in kept.part(i, df).collect()} for i in range(4)] == keys
        kept.drop(0)
        assert sorted(kept.part(1).collect(), key=repr) == sorted(parts[1], key=repr)
        none = ScratchParts(df.filter("id = 99"), "none", "id", 3)
        assert none.table().collect() == [] == none.part(2).collect()
