from corpusmill.operators.validate import (drop_incomplete_qa, effective_text, format_qa, route_format,
                                           validate_required)

SCHEMA = "sample_id long, question string, solution string, answer string, text string, input string, output string"


def test_validate_required(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert validate_required(empty, ["question"]).first().valid is False
    one = spark.createDataFrame([(1, None, "s", None, None, None, None)], SCHEMA)
    assert validate_required(one).first().valid is True  # no list: emptiness only
    r = validate_required(one, ["question", "solution", "answer"]).first()
    assert (r.valid, r.first_row, r.first_field) == (False, 1, "question")
    r = validate_required(one, ["answer", "question"]).first()
    assert r.first_field == "answer"  # first in required order


def test_qa_blank_answer_not_routed_to_text(spark):
    df = spark.createDataFrame([(1, "q", "s", "  ", "has text", None, None),
                                (2, None, None, None, "t", None, None),
                                (3, None, None, None, None, "i", "o"),
                                (4, None, None, None, None, "i", None)], SCHEMA)
    routed = {r.sample_id: r.kind for r in route_format(df).collect()}
    assert routed == {1: "qa", 2: "text", 3: "io", 4: "unknown"}
    kept = sorted(r.sample_id for r in drop_incomplete_qa(route_format(df)).collect())
    assert kept == [2, 3]


def test_format_and_effective_text(spark):
    df = spark.createDataFrame([(1, " q ", "\n sol ", " a", None, None, None)], SCHEMA)
    f = format_qa(drop_incomplete_qa(route_format(df)))
    r = f.first()
    assert r.text == "<think>\n\nsol\n\n</think>\n\na"
    assert [m.role for m in r.messages] == ["user", "assistant"] and r.messages[0].content == "q"
    eff = f.select(effective_text(f).alias("e")).first().e
    assert eff.startswith("<|im_start|>system\n") and eff.endswith("<|im_start|>assistant\n" + r.text + "<|im_end|>\n")
