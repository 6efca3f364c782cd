import json

from pyspark.sql import functions as F

from evalsmith.functions.replies import (
    answer_sections,
    guideline_reply_label,
    keep_first_distinct,
    option_vote,
    parse_action_reply,
    parse_json_object,
    qa_reply_label,
)


def _col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_qa_reply_label_parity(spark):
    vals = ["0", "1", "2", "10", "not sure", "pass", "none", ""]
    assert _col(spark, vals, qa_reply_label) == [0, 1, 2, 1, 1, 2, 1, 0]


def test_qa_reply_label_abstain_first(spark):
    assert _col(spark, ["not sure", "skip", "1"], lambda c: qa_reply_label(c, abstain_first=True)) == [2, 2, 1]


def test_guideline_reply_label(spark):
    vals = ["0", "answer: 2 or 1", "unsure", "incorrect", "supported", "not supported", "", "hmm", None]
    assert _col(spark, vals, guideline_reply_label) == [0, 2, 2, 1, 0, 1, 2, 2, 2]


def test_option_vote(spark):
    vals = ["Option 1", "option2", "I pick OPTION 2.", "12", "neither", "The second (2)", "option 3", None]
    assert _col(spark, vals, option_vote) == ["1", "2", "2", None, None, "2", None, None]


def test_answer_sections_last_wins(spark):
    text = "#Question#: q?\n\n#Knowledge#: k1\nk2\n#Hallucinated Answer#: a1\n #Hallucinated Answer#: a2\n"
    r = _col(spark, [text], answer_sections)[0]
    assert r["question"] == "q?"
    assert r["knowledge"] == "k1\nk2"
    assert r["hallucinated_answer"] == "a2"
    assert r["ground_truth_answer"] == ""


def test_keep_first_distinct(spark):
    df = spark.createDataFrame([(["a", " A! ", "", "b", "a."],)], "x array<string>")
    assert df.select(keep_first_distinct("x")).first()[0] == ["a", "b"]


def test_parse_action_replies(spark):
    cases = [
        ('{"recommended_actions":["a","A!","b"]}', ["a", "b"]),
        ('Sure. {"recommended_actions": ["x", "y"]} done', ["x", "y"]),
        ('["p", "q", "p"]', ["p", "q"]),
        ('{"actions":"x"}', ["x"]),
        ("- a\n2) b\n* c\n  \n[", ["a", "b", "c"]),
        ('{"recommended_actions": []}', []),
        ("", []),
        (None, []),
        ('{"recommendations": [1, {"k": 2}]}', ["1", '{"k":2}']),
    ]
    got = _col(spark, [c for c, _ in cases], parse_action_reply)
    assert got == [e for _, e in cases]


def test_parse_action_replies_legacy_empty_list(spark):
    got = _col(spark, ['{"recommended_actions": []}'], lambda c: parse_action_reply(c, legacy_empty_list=True))
    assert got == [['{"recommended_actions": []}']]


def test_parse_json_object(spark):
    vals = ['{"a": 1}', 'text {"a": 2} tail', "```json\n{\"a\": 3}\n```", "no json", "[1,2]"]
    got = _col(spark, vals, lambda c: F.to_json(parse_json_object(c, fenced=True)))
    assert [json.loads(g) if g else None for g in got] == [{"a": 1}, {"a": 2}, {"a": 3}, None, None]
