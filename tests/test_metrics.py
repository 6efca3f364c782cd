import math

from pyspark.sql import functions as F

from evalsmith.functions.numeric import truncate_float
from evalsmith.operators.metrics import (
    abstaining_binary_metrics,
    action_summary,
    decision,
    guideline_judge_summary,
    qa_judge_metrics,
    truncate_floats,
)


def test_truncate_float_edges(spark):
    vals = [0.9999, -0.9999, None, float("nan"), float("inf"), 1e300, 0.1234567]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(truncate_float("x", 3)).collect()]
    assert got[0] == 0.999 and got[1] == -0.999 and got[2] is None
    assert math.isnan(got[3]) and got[4] == float("inf") and got[5] == 1e300
    assert got[6] == 0.123


def test_truncate_floats_only_floats(spark):
    df = spark.createDataFrame([("k", 3, 0.98765)], "k string, i int, x double")
    r = truncate_floats(df, 2).first()
    assert r == ("k", 3, 0.98)


def test_abstaining_metrics_counts(spark):
    rows = [("m", 1, 1), ("m", 1, 0), ("m", 0, 0), ("m", 0, 1), ("m", 2, 1), ("n", 2, 1), ("n", 2, 0)]
    df = spark.createDataFrame(rows, "model_name string, predicted_label int, label int")
    out = {r["model_name"]: r for r in abstaining_binary_metrics(df, ["model_name"], digits=None).collect()}
    m = out["m"]
    # tp=1 fp=1 fn=1 tn=1 over 4 decided, 1 abstained of 5
    assert m["accuracy"] == 0.5 and m["precision"] == 0.5 and m["recall"] == 0.5 and m["f1"] == 0.5
    assert m["abstain_rate"] == 0.2 and m["coverage"] == 0.8 and m["support"] == 5
    n = out["n"]
    assert n["accuracy"] is None and n["precision"] is None and n["f1"] is None
    assert n["abstain_rate"] == 1.0 and n["coverage"] == 0.0


def test_zero_denominators(spark):
    # all negative slice: P = R = F1 = 0, accuracy defined
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 0)], "model_name string, predicted_label int, label int")
    r = abstaining_binary_metrics(df, ["model_name"]).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_guideline_summary_slices(spark):
    rows = [
        ("m", "hard", "challenging_example", 1, 1),
        ("m", "medium", "challenging_example", 1, 0),
        ("m", "concordant", "source_case", 0, 0),
        ("m", None, "source_case", 0, 2),
    ]
    df = spark.createDataFrame(rows, "model_name string, difficulty string, case_kind string, label int, predicted_label int")
    out = {(r["slice_name"], r["slice_rank"]): r for r in guideline_judge_summary(df).collect()}
    assert out[("overall", 0)]["support"] == 4
    assert out[("nan", 1)]["support"] == 1 and out[("nan", 1)]["accuracy"] is None
    assert out[("source_case", 2)]["support"] == 2
    # invariant: overall n = sum over a slice family
    assert sum(r["support"] for k, r in out.items() if k[1] == 1) == 4
    for r in out.values():
        assert abs(r["coverage"] - (1 - r["abstain_rate"])) <= 0.0011


def test_qa_judge_metrics_all_abstain(spark):
    rows = [("m", "No", "easy", 1, 2), ("m", "No", "hard", 0, 2)]
    df = spark.createDataFrame(rows, "model_name string, knowledge string, final_difficulty_level string, label int, predicted_label int")
    r = qa_judge_metrics(df).first()
    # Q3: overall P/R/F1 are 0 when all abstain, per-difficulty null
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert r["easy_precision"] is None and r["easy_percent_of_time_not_sure_chosen"] == 1.0
    assert r["medium_percent_of_time_not_sure_chosen"] is None
    assert r["overall_percent_of_time_not_sure_chosen"] == 1.0


def test_decision(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (0, 1)], "predicted_label int, label int")
    assert [r[0] for r in df.select(decision()).collect()] == ["Correct", "Not Sure", "Incorrect"]


def test_action_summary_case_accuracy_equals_exact(spark):
    rows = [
        ("m", "source_case", 1, 1.0, 1.0, 1.0, 1.0, 0, 0, 2, 2),
        ("m", "challenging_example", 0, 0.5, 1.0, 0.666, 0.8, 1, 0, 2, 1),
        ("m", "challenging_example", 0, 0.0, 1.0, 0.0, 0.0, 1, 0, 1, 0),
    ]
    schema = ("model_name string, case_kind string, exact_match int, action_precision double, action_recall double, "
              "action_f1 double, average_match_score double, num_unmatched_generated_actions int, "
              "num_unmatched_reference_actions int, num_generated_actions int, num_reference_actions int")
    out = action_summary(spark.createDataFrame(rows, schema)).collect()
    names = {r["slice_name"] for r in out}
    assert {"overall", "source_case", "challenging_example", "reference_actions_0", "reference_actions_1", "reference_actions_2"} == names
    for r in out:
        assert r["case_accuracy"] == r["exact_match_rate"]
    assert sum(r["support"] for r in out if r["slice_rank"] == 2) == 3
    assert F is not None
