import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from evalsmith.operators.generation import (
    any_fooled,
    difficulty_from_votes,
    final_answer,
    first_success,
    pending,
    widen_attempts,
)
from evalsmith.operators.inference import refine_rounds, score_batches
from evalsmith.operators.prompts import build_prompts, render

SMOKE = "/root/testdata/sf0.001"


def test_difficulty_votes(spark):
    df = spark.createDataFrame([([],), ([True],), ([True, True, False],), ([True, False, False],), ([False, False],)], "v array<boolean>")
    got = [(r[0], r[1]) for r in df.select(difficulty_from_votes("v"), any_fooled("v")).collect()]
    assert got == [("hard", False), ("hard", True), ("medium", True), ("easy", True), ("easy", False)]


def test_first_success_and_final_answer(spark):
    rows = [
        ("a", 1, False, "x1", 0.9, "easy"), ("a", 2, True, "x2", 0.1, "hard"), ("a", 3, True, "x3", 0.5, "medium"),
        ("b", 1, False, "y1", 0.4, "easy"), ("b", 2, False, "", 0.99, "easy"), ("b", 3, False, "y3", 0.4, "medium"),
    ]
    df = spark.createDataFrame(rows, "item_id string, attempt_no int, any_fooled boolean, answer string, similarity double, difficulty string")
    kept = first_success(df)
    assert sorted((r[0], r[1]) for r in kept.select("item_id", "attempt_no").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    fa = {r["item_id"]: r for r in final_answer(kept).collect()}
    assert fa["a"]["least_similar_answer"] == "x2" and fa["a"]["succeeded"]
    # no success: most similar non-empty answer, ties to the earliest attempt
    assert fa["b"]["least_similar_answer"] == "y1" and fa["b"]["chosen_attempt"] == 1


def test_widen_and_pending(spark):
    rows = [("a", 1, "h1", "j1", "easy", [(True, "r")]), ("a", 2, "h2", "j2", "hard", [(False, None)])]
    df = spark.createDataFrame(rows, "item_id string, attempt_no int, answer string, justification string, difficulty string, votes array<struct<fooled:boolean,reasoning:string>>")
    w = widen_attempts(df, 2, 1).first()
    assert w["hallucinated_answer_2"] == "h2" and w["fooled_discriminator_1_1"] is True and w["difficulty_level_1"] == "easy"
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert [r[0] for r in pending(items, df, "item_id").collect()] == ["b"]


def test_prompts(spark):
    df = spark.createDataFrame([("q", None)], "question string, answer string")
    assert df.select(render("Q: {question} A: {answer}!")).first()[0] == "Q: q A: !"
    p = build_prompts(df, "Q: {question}", system="sys", merge_system=False).first()
    assert [m["role"] for m in p["messages"]] == ["system", "user"]


def test_score_batches_failure_gives_empty(spark):
    df = spark.createDataFrame([("a", "p1"), ("b", "p2")], "k string, prompt string")

    def boom(b: pd.DataFrame) -> pd.Series:
        raise RuntimeError("model down")

    out = score_batches(df, boom, ["k"], ["prompt"], "reply").collect()
    assert sorted(r["k"] for r in out) == ["a", "b"] and all(r["reply"] is None for r in out)


def test_refine_rounds_stops_items_that_succeed(spark):
    items = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "item_id string, prompt string")
    gen = lambda b: b.iloc[:, 0] + "-a"
    rev = lambda b: b.iloc[:, 1] + "+"
    judge = lambda b: b.iloc[:, 0].map(lambda a: "Option 2" if a.count("+") >= 1 and a.startswith("p1") else "Option 1")
    att = refine_rounds(items, "item_id", gen, [judge], rev, rounds=2)
    rows = att.collect()
    by = {}
    for r in rows:
        by.setdefault(r["item_id"], []).append(r["attempt_no"])
    assert sorted(by["1"]) == [1, 2]  # succeeded at the revision of round 1
    assert sorted(by["0"]) == [1, 2, 3, 4]


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "slice_name" in df.columns
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 30
    assert F is not None


def test_refine_rounds_resume_skips_done_items(spark):
    """A run stopped after round 1 resumes with the items not yet done (K5)."""
    items = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "item_id string, prompt string")
    gen = lambda b: b.iloc[:, 0] + "-a"
    rev = lambda b: b.iloc[:, 1] + "+"
    judge = lambda b: b.iloc[:, 0].map(lambda a: "Option 2" if a.startswith(("p1", "p3")) else "Option 1")
    first = refine_rounds(items, "item_id", gen, [judge], rev, rounds=1)
    done = first.filter("any_fooled").select("item_id")
    assert sorted(r[0] for r in done.collect()) == ["1", "3"]
    resumed = refine_rounds(items, "item_id", gen, [judge], rev, rounds=1, done=done)
    assert sorted({r[0] for r in resumed.select("item_id").collect()}) == ["0", "2", "4", "5"]
