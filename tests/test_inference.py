"""Model batches and refine rounds with models that fail, count and are random."""

import os
import uuid

import pandas as pd
import pytest

from evalsmith.operators.inference import attach_responses, refine_rounds, score_batches
from evalsmith.operators.matching import score_distinct_pairs


def test_a_bad_row_leaves_the_others(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "k long, prompt string").coalesce(1)

    def model(b: pd.DataFrame) -> pd.Series:
        if (b["prompt"] == "p7").any():
            raise RuntimeError("too long")
        return b["prompt"] + "!"

    rows = {r["k"]: r for r in score_batches(df, model, ["k"], ["prompt"], "reply").collect()}
    assert rows[7]["reply"] is None and rows[7]["error"] == "RuntimeError: too long"
    assert all(rows[i]["reply"] == f"p{i}!" and rows[i]["error"] is None for i in range(20) if i != 7)


def test_a_coding_error_fails(spark):
    df = spark.createDataFrame([(1, "p")], "k long, prompt string")
    with pytest.raises(Exception, match="no_such_name"):
        score_batches(df, lambda b: no_such_name, ["k"], ["prompt"]).collect()  # noqa: F821


def counted(folder: str, name: str, reply):
    """A model that notes every row it is called with and what it replied."""

    def model(b: pd.DataFrame) -> pd.Series:
        out = [reply(*r) for r in b.itertuples(index=False)]
        with open(f"{folder}/{name}-{uuid.uuid4().hex}", "w") as f:
            f.write("\x01".join(f"{r[-1] if name != 'revise' else r[1]}\x02{o}" for r, o in zip(b.itertuples(index=False), out, strict=True)))
        return pd.Series(out)

    return model


def calls(folder: str, name: str) -> list[list[str]]:
    out = []
    for f in os.listdir(folder):
        if f.startswith(name + "-"):
            with open(f"{folder}/{f}") as g:
                out += [x.split("\x02") for x in g.read().split("\x01") if x]
    return out


def test_what_is_stored_was_judged_and_each_call_is_made_once(spark, tmp_path):
    folder = str(tmp_path)
    n = 20
    items = spark.createDataFrame([(i, f"p{i}") for i in range(n)], "item_id long, prompt string").repartition(4)
    gen = counted(folder, "generate", lambda p: "" if p == "p3" else f"#Hallucinated Answer#: {uuid.uuid4().hex}\n#Justification of Hallucinated answer#: why")
    judges = [counted(folder, f"judge{j}", lambda a, j=j: "Option 2" if a.startswith("0") and j else "Option 1") for j in range(3)]
    rev = counted(folder, "revise", lambda p, a, r: f"{a}+{r}")
    rows = refine_rounds(items, "item_id", gen, judges, rev, rounds=2).collect()
    rows = refine_rounds(items.limit(0), "item_id", gen, judges, rev, rounds=2).collect() + rows
    first = [r for r in rows if r["attempt_no"] == 1]
    assert len(first) == n - 1 and {r["item_id"] for r in rows} == set(range(n)) - {3}
    assert all(r["justification"] == "why" for r in rows)
    # one call per prompt and stage: generations are the rows and the empty replies
    made = calls(folder, "generate")
    assert len(made) == len(rows) + sum(reply == "" for _, reply in made)
    assert len(calls(folder, "revise")) == sum(not r["any_fooled"] and r["stage"] == "generate" for r in rows)
    for j in range(3):
        asked = calls(folder, f"judge{j}")
        assert sorted(a for a, _ in asked) == sorted(r["answer"] for r in rows)
        votes = dict(asked)
        assert all(r["votes"][j] == (votes[r["answer"]] == "Option 2") for r in rows)
    # a revision's prompt has the feedback on the attempt before it
    by = {(r["item_id"], r["attempt_no"]): r for r in rows}
    prompts = [p for p, _ in made if "+Option 1" in p]
    assert sorted(p.split("\n")[-1].split("+")[0] for p in prompts) == sorted(by[i, k - 1]["answer"] for i, k in by if k % 2 == 0)
    for i, k in by:
        assert k == 1 or not any(by[i, x]["any_fooled"] for x in range(1, k) if (i, x) in by)


def test_attach_responses_and_score_distinct_pairs(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "prompt_id long, text string")
    replies = spark.createDataFrame([(1, "yes")], "prompt_id long, raw_output string")
    assert {r["prompt_id"]: r["raw_output"] for r in attach_responses(cases, replies, ["prompt_id"], how="left").collect()} == {1: "yes", 2: None}
    assert attach_responses(cases, replies, ["prompt_id"]).count() == 1
    pairs = spark.createDataFrame([(1, "x", "yy"), (2, "x", "yy"), (3, "x", "x")], "i long, text_a string, text_b string")
    seen = []

    def scorer(distinct):
        seen.append(distinct.count())
        return distinct.selectExpr("*", "length(text_a) / length(text_b) AS forward", "1.0D AS backward")

    got = {r["i"]: (r["forward"], r["score"]) for r in score_distinct_pairs(pairs, scorer).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.5, 0.5), 3: (1.0, 1.0)} and seen == [2]
