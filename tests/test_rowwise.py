"""Cases compared inside their rows against the token index, and which rows go where."""

import random

import pytest
from pyspark.sql import functions as F

from evalsmith.operators import rowwise
from evalsmith.operators.matching import (
    case_pairs,
    explode_actions,
    greedy_pairs,
    keep_first_distinct_rows,
    match_metrics,
    overlap_candidates,
    semantic_dedup,
    token_pair_scores,
    tokenize,
)
from evalsmith.operators.rowwise import fits_row, row_candidates, row_case_pairs, row_matches, row_semantic_dedup, split_cases
from evalsmith.plans import registry

SCHEMA = "case_id string, generated_actions array<string>, reference_actions array<string>"


def _lists(rng, n):
    words = ["a", "b", "cc", "dd", "e", "!!", "A", "É"]
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    one = lambda: None if rng.random() < 0.05 else [text() for _ in range(rng.randrange(8))]
    return [(f"c{i}", one(), one()) for i in range(n)]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(_lists(random.Random(3), 60), SCHEMA).localCheckpoint()


def _sides(cases):
    return [tokenize(explode_actions(cases, ["case_id"], c)) for c in ("generated_actions", "reference_actions")]


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("mode, column", [("min", "overlap"), ("max", "score")])
def test_row_candidates(cases, mode, column):
    gen, ref = _sides(cases)
    for tau in (0.3, 0.5, 1.0):
        own = token_pair_scores(row_candidates(cases, ["case_id"], "generated_actions", "reference_actions", tau, mode))
        got = {(r["case_id"], r["a"], r["b"]): r[column] for r in own.collect()}
        index = overlap_candidates(gen, ref, ["case_id"], tau, mode=mode)
        index = index.join(gen.select("case_id", F.col("idx").alias("a"), F.col("tok").alias("tok_a")), ["case_id", "a"])
        index = token_pair_scores(index.join(ref.select("case_id", F.col("idx").alias("b"), F.col("tok").alias("tok_b")), ["case_id", "b"]))
        want = {(r["case_id"], r["a"], r["b"]): r[column] for r in index.where(F.col(column) >= tau).collect()}
        assert want and {k: v for k, v in got.items() if v >= tau} == want


def test_row_case_pairs(cases):
    own = row_case_pairs(cases, ["case_id"], "generated_actions", "reference_actions", 0.5)
    assert _rows(own) == _rows(case_pairs(*_sides(cases), ["case_id"], 0.5))


def test_row_matches(cases):
    gen, ref = _sides(cases)
    pairs = gen.withColumnsRenamed({"idx": "g", "text": "ta", "tok": "tok_a"}).join(ref.withColumnsRenamed({"idx": "r", "text": "tb", "tok": "tok_b"}), "case_id")
    want = match_metrics(cases, greedy_pairs(token_pair_scores(pairs), ["case_id"], 0.5), ["case_id"])
    got = row_matches(cases, 0.5)
    exact = [c for c in want.columns if c != "average_match_score"]
    assert got.columns == want.columns and _rows(got.select(*exact)) == _rows(want.select(*exact))
    mean = {r["case_id"]: r["average_match_score"] for r in want.collect()}
    assert all(r["average_match_score"] == pytest.approx(mean[r["case_id"]]) for r in got.collect())


def test_row_semantic_dedup(cases):
    for t in (0.3, 0.5, 0.8):
        items = keep_first_distinct_rows(explode_actions(cases, ["case_id"], "generated_actions"), ["case_id"])
        assert _rows(row_semantic_dedup(cases, ["case_id"], "generated_actions", t)) == _rows(semantic_dedup(items, ["case_id"], t))


def test_split_cases(spark, monkeypatch):
    monkeypatch.setattr(rowwise, "ROW_ITEMS", 3)
    monkeypatch.setattr(rowwise, "ROW_CHARS", 20)
    rows = [("short", ["a"], None), ("long", ["a"] * 4, []), ("wide", ["a" * 21], []), ("twice", ["a"], []), ("twice", ["b"], []), (None, ["a"], [])]
    own, rest = split_cases(spark.createDataFrame(rows, SCHEMA), ["case_id"], fits_row("generated_actions", "reference_actions"))
    assert [r["case_id"] for r in own.collect()] == ["short"] and rest.columns == own.columns
    assert sorted(str(r["case_id"]) for r in rest.collect()) == ["None", "long", "twice", "twice", "wide"]
    own, rest = split_cases(spark.createDataFrame(rows[:1], SCHEMA), ["case_id"], F.lit(True))
    assert rest is None and own.count() == 1


@pytest.fixture()
def data(spark, tmpdir_path):
    rng = random.Random(9)
    text = lambda sep: sep.join(" ".join(rng.choice(["give", "take", "one", "two", "day", "pill"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9)))
    talk = [(i // 3, i % 3, "user", text(". ")) for i in range(40)]
    talk += [talk[4], (None, 1, "user", text(". "))]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    docs = [(i, text("\n")) for i in range(40)] + [(7, text("\n")), (None, text("\n")), (50, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    return tmpdir_path


NAMES = ["action_pairs", "within_case_pairs", "greedy_match", "semantic_dedup"]


# Greedy matching of both ways: test_row_matches.
@pytest.mark.parametrize("name", [n for n in NAMES if n != "greedy_match"])
def test_rows_and_rest_agree(spark, data, monkeypatch, name):
    """The same rows whichever way a case goes, repeated and null keys too."""
    own = _rows(registry.queries()[name](spark, data))
    monkeypatch.setattr(rowwise, "ROW_ITEMS", -1)
    assert own and own == _rows(registry.queries()[name](spark, data))


@pytest.mark.parametrize("name", [*NAMES, "diagnose", "rescore_saved"])
def test_whole_cases_are_not_shuffled(spark, tmpdir_path, name):
    """Neither texts nor token rows are shuffled, broadcast or joined."""
    spark.createDataFrame([(1, t, "user", "give one. take two") for t in range(9)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    spark.createDataFrame([(i, "one two\ntwo one") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    plan = registry.queries()[name](spark, tmpdir_path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_token_rows_are_never_broadcast(cases):
    gen, ref = _sides(cases)
    for mode in ("min", "max"):
        for right in (ref, None):
            plan = overlap_candidates(gen, right, ["case_id"], 0.5, mode=mode)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
