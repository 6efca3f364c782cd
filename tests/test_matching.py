"""Matching operators against plain-Python restatements on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from evalsmith.operators.diagnostics import rescore_saved
from evalsmith.operators.matching import (
    case_pairs,
    explode_actions,
    greedy_match,
    match_metrics,
    overlap_candidates,
    redundancy_edges,
    semantic_dedup,
    tokenize,
)
from evalsmith.operators.settle import settle


def py_greedy(edges, t):
    """Restated loop: best free pair by (score desc, g, r) while >= t."""
    out, ug, ur = [], set(), set()
    for s, g, r in sorted(((s, g, r) for g, r, s in edges), key=lambda x: (-x[0], x[1], x[2])):
        if s < t:
            break
        if g in ug or r in ur:
            continue
        ug.add(g)
        ur.add(r)
        out.append((g, r))
    return out


def _random_edges(rng, n_cases=60):
    rows, by_case = [], {}
    for c in range(n_cases):
        ng, nr = rng.randint(0, 6), rng.randint(0, 6)
        es = []
        for g in range(ng):
            for r in range(nr):
                s = rng.choice([0.2, 0.5, 0.5, 0.75, 1.0, rng.random()])
                es.append((g, r, s))
                rows.append((f"c{c}", g, r, float(s)))
        by_case[f"c{c}"] = es
    return rows, by_case


def _check_greedy(spark, rows, by_case):
    df = spark.createDataFrame(rows, "case_id string, g int, r int, score double")
    got = {}
    for row in greedy_match(df, ["case_id"], 0.5).collect():
        got.setdefault(row["case_id"], []).append((row["ord"], row["g"], row["r"]))
    for c, es in by_case.items():
        assert [(g, r) for _, g, r in sorted(got.get(c, []))] == py_greedy(es, 0.5), c


def test_greedy_equals_loop(spark):
    _check_greedy(spark, *_random_edges(random.Random(7)))


def test_greedy_long_chain_and_hot_case(spark):
    # each edge is dominated by the next one: only the last is settled a round
    chain = [(i // 2, (i + 1) // 2, 0.5 + i / 20_001) for i in range(10_000)]
    rng = random.Random(5)
    hot = [(g, r, rng.choice([0.5, 0.6, 0.9])) for g in range(60) for r in range(60)]
    rows = [("chain", g, r, s) for g, r, s in chain] + [("hot", g, r, s) for g, r, s in hot] + [(f"c{i}", 0, 0, 0.7) for i in range(500)]
    _check_greedy(spark, rows, {"chain": chain, "hot": hot})


def py_dedup(items, redundant):
    kept, removed = [], []
    for j in items:
        if any(redundant(i, j) for i in kept):
            removed.append(j)
        else:
            kept.append(j)
    return kept, removed


def test_semantic_dedup_chain_keeps_a_and_c(spark):
    # a~b and b~c but not a~c: the scan keeps a, removes b, keeps c
    items = spark.createDataFrame([("k", 0, "alpha beta"), ("k", 1, "beta gamma"), ("k", 2, "gamma delta")], "case_id string, idx int, text string")
    edges = spark.createDataFrame([("k", 0, 1), ("k", 1, 2)], "case_id string, a int, b int")
    out = {r["idx"]: r["status"] for r in semantic_dedup(items, ["case_id"], 0.5, edges=edges).collect()}
    assert out == {0: "kept", 1: "removed", 2: "kept"}


def test_semantic_dedup_long_chain(spark):
    n = 10_000
    items = spark.createDataFrame([("k", i, f"t{i}") for i in range(n)], "case_id string, idx int, text string")
    edges = spark.createDataFrame([("k", i, i + 1) for i in range(n - 1)], "case_id string, a int, b int")
    out = semantic_dedup(items, ["case_id"], 0.5, edges=edges)
    assert {r["idx"] for r in out.where("status = 'kept'").collect()} == set(range(0, n, 2))


def test_semantic_dedup_with_a_scorer(spark):
    """A scorer that calls texts of equal length alike, over the caller's pairs."""
    items = spark.createDataFrame([("k", 0, "aa"), ("k", 1, "b"), ("k", 2, "cc"), ("k", 3, "d"), ("j", 0, "x"), ("j", 1, "y")], "case_id string, idx int, text string")
    candidates = spark.createDataFrame([("k", 0, 1), ("k", 0, 2), ("k", 1, 3), ("j", 0, 1)], "case_id string, a int, b int")

    def same_length(pairs):
        alike = (F.length("text_a") == F.length("text_b")).cast("double")
        return pairs.withColumns({"forward": alike, "backward": alike})

    out = semantic_dedup(items, ["case_id"], 0.5, scorer=same_length, candidates=candidates).where("status = 'removed'").collect()
    assert {(r["case_id"], r["idx"]) for r in out} == {("k", 2), ("k", 3), ("j", 1)}
    with pytest.raises(ValueError):
        semantic_dedup(items, ["case_id"], 0.5, scorer=same_length)
    with pytest.raises(ValueError):
        semantic_dedup(items, ["case_id"], 0.0)


def test_semantic_dedup_random_vs_loop(spark):
    rng = random.Random(11)
    item_rows, edge_rows, truth = [], [], {}
    for c in range(40):
        n = rng.randint(1, 9)
        es = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3}
        for i in range(n):
            item_rows.append((f"c{c}", i, f"t{i}"))
        for i, j in es:
            edge_rows.append((f"c{c}", i, j))
        kept, _ = py_dedup(list(range(n)), lambda i, j, es=es: (i, j) in es)
        truth[f"c{c}"] = set(kept)
    items = spark.createDataFrame(item_rows, "case_id string, idx int, text string")
    edges = spark.createDataFrame(edge_rows, "case_id string, a int, b int")
    got = {}
    for r in semantic_dedup(items, ["case_id"], 0.5, edges=edges).collect():
        if r["status"] == "kept":
            got.setdefault(r["case_id"], set()).add(r["idx"])
    assert got == truth


def _toks(s):
    import re

    n = re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
    return set(n.split()) if n else set()


def test_overlap_candidates_exact(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    a_rows, b_rows = [], []
    for c in range(15):
        for i in range(rng.randint(0, 6)):
            a_rows.append((f"c{c}", i, " ".join(rng.sample(vocab, rng.randint(1, 6)))))
        for i in range(rng.randint(0, 6)):
            b_rows.append((f"c{c}", i, " ".join(rng.sample(vocab, rng.randint(1, 6)))))
    a = spark.createDataFrame(a_rows, "case_id string, idx int, text string")
    b = spark.createDataFrame(b_rows, "case_id string, idx int, text string")
    for mode, norm in (("min", min), ("max", max)):
        for tau in (0.3, 0.5, 0.8):
            got = {(r[0], r[1], r[2]) for r in overlap_candidates(tokenize(a), tokenize(b), ["case_id"], tau, mode=mode).collect()}
            for ca, ia, ta in a_rows:
                for cb, ib, tb in b_rows:
                    if ca != cb:
                        continue
                    x, y = _toks(ta), _toks(tb)
                    if x and y and len(x & y) >= tau * norm(len(x), len(y)) - 1e-12:
                        assert (ca, ia, ib) in got, (mode, tau, ta, tb)
    # self pairs in max mode
    got = {(r[0], r[1], r[2]) for r in overlap_candidates(tokenize(a), None, ["case_id"], 0.5, mode="max").collect()}
    for ca, ia, ta in a_rows:
        for cb, ib, tb in a_rows:
            if ca == cb and ia < ib:
                x, y = _toks(ta), _toks(tb)
                if x and y and len(x & y) >= 0.5 * max(len(x), len(y)):
                    assert (ca, ia, ib) in got


def test_redundancy_edges_match_rule(spark):
    texts = ["give aspirin daily", "give aspirin", "order a chest x ray", "aspirin daily give now", "x ray of chest"]
    items = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "case_id string, idx int, text string")
    got = {(r["a"], r["b"]) for r in redundancy_edges(items, ["case_id"], 0.6).collect()}
    want = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            x, y = _toks(texts[i]), _toks(texts[j])
            inter = len(x & y)
            fwd, bwd = inter / len(x), inter / len(y)
            lex = inter / min(len(x), len(y))
            if min(fwd, bwd) >= 0.6 or (lex >= 0.5 and max(fwd, bwd) >= 0.6):
                want.add((i, j))
    assert got == want


def test_match_metrics_empty_rules(spark):
    cases = spark.createDataFrame(
        [("both", [], []), ("nogen", [], ["r"]), ("noref", ["g"], []), ("some", ["a", "b"], ["a"])],
        "case_id string, generated_actions array<string>, reference_actions array<string>",
    )
    matched = spark.createDataFrame([("some", 0, 0, 0.9, 1)], "case_id string, g int, r int, score double, ord int")
    out = {r["case_id"]: r for r in match_metrics(cases, matched, ["case_id"]).collect()}
    b = out["both"]
    assert (b["action_precision"], b["action_recall"], b["action_f1"], b["exact_match"], b["average_match_score"]) == (1.0, 1.0, 1.0, 1, 1.0)
    n = out["nogen"]
    assert (n["action_precision"], n["action_recall"], n["action_f1"], n["exact_match"]) == (1.0, 0.0, 0.0, 0)
    r = out["noref"]
    assert (r["action_precision"], r["action_recall"], r["exact_match"], r["average_match_score"]) == (0.0, 1.0, 0, 0.0)
    s = out["some"]
    assert s["num_matched_actions"] == 1 and s["unmatched_generated_actions"] == ["b"] and s["action_recall"] == 1.0
    assert s["matched_pairs"][0]["reference_action"] == "a"


def test_rescore_saved_q6(spark):
    df = spark.createDataFrame(
        [([], [], []), (["a", "a"], ["x"], [("a", "x", 0.9), ("a", "gone", 0.8)])],
        "generated_actions array<string>, reference_actions array<string>, "
        "matched_pairs array<struct<generated_action:string,reference_action:string,score:double>>",
    )
    rows = rescore_saved(df).collect()
    assert (rows[0]["action_precision"], rows[0]["action_f1"], rows[0]["exact_match"]) == (0.0, 0.0, 1)
    # the pair whose reference was de-duplicated away is dropped; texts collapse
    assert rows[1]["num_matched_actions"] == 1 and rows[1]["unmatched_generated_actions"] == []


def test_no_cartesian_in_candidate_plan(spark):
    a = spark.createDataFrame([("c", 0, "x y")], "case_id string, idx int, text string")
    plan = overlap_candidates(tokenize(a), tokenize(a), ["case_id"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert explode_actions is not None and F is not None


def test_label_action_pairs_scores_long_actions(spark, tmpdir_path):
    """Every pair has scores, however long; only a failing scorer leaves 'unknown'."""
    from evalsmith.operators.matching import label_pairs, token_pair_scores
    from evalsmith.plans.records import label_action_pairs

    long = " ".join(f"word{i}" for i in range(500))
    rows = [(1, t, "user", f"give {long} daily. then {long} twice. stop") for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmpdir_path}/conversations.parquet")
    got = label_action_pairs(spark, tmpdir_path).collect()
    assert got and all(r["score"] is not None and r["label"] in ("same", "different") for r in got)
    assert {"same", "different"} == {r["label"] for r in got}

    def failing(distinct):
        some = F.col("text_b") != "fails"
        return token_pair_scores(distinct).withColumns({c: F.when(some, F.col(c)) for c in ("forward", "backward")})

    pairs = spark.createDataFrame([("a b", "a b"), ("a b", "fails"), ("a", long), ("", "fails")], "text_a string, text_b string")
    labels = {(r["text_a"], r["text_b"]): r["label"] for r in label_pairs(pairs, 0.5, scorer=failing).collect()}
    assert labels == {("a b", "a b"): "same", ("a b", "fails"): "unknown", ("a", long): "different", ("", "fails"): "different"}


def test_long_chain_in_one_case(spark):
    """One case, every decision waiting for the one before."""
    n = 100_000
    items = spark.range(n).selectExpr("'k' AS case_id", "cast(id AS int) AS idx", "'t' AS text")
    edges = spark.range(n - 1).selectExpr("'k' AS case_id", "cast(id AS int) AS a", "cast(id + 1 AS int) AS b")
    out = semantic_dedup(items, ["case_id"], 0.5, edges=edges)
    wrong = out.where((F.col("status") == "kept") != (F.col("idx") % 2 == 0))
    assert wrong.count() == 0 and "MapInPandas" not in out._jdf.queryExecution().toString()


def test_settle_against_the_scan(spark):
    """Random systems with both signs, of nulls among the keys, also when rounds run out."""
    rng = random.Random(17)
    rows, truth = [], {}
    for case in [None, "a", "b", "c"]:
        value = {}
        for v in range(60):
            own = {(rng.randrange(v), rng.random() < 0.5) for _ in range(rng.randrange(4))} if v else set()
            value[v] = not any(value[t] != negated for t, negated in own)
            rows.append((case, v, None, False))
            rows += [(case, v, t, negated) for t, negated in own]
        truth |= {(case, v): x for v, x in value.items()}
    literals = spark.createDataFrame(rows, "case_id string, v long, t long, negated boolean")
    values, left = settle(literals, ["case_id"])
    assert left is None and {(r["case_id"], r["v"]): r["value"] for r in values.collect()} == truth
    values, left = settle(literals, ["case_id"], rounds=2)
    some = {(r["case_id"], r["v"]): r["value"] for r in values.collect()}
    assert some.items() <= truth.items() and {(r["case_id"], r["v"]) for r in left.collect()} == truth.keys() - some.keys()


def test_case_pairs_are_all_pairs(spark):
    rng = random.Random(21)
    words = ["a", "b", "c", "d", "e", "!!", "A"]
    lists = {c: [[" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(7))] for _ in range(2)] for c in ("x", "y", "z", "w")}
    side = lambda k: spark.createDataFrame([(c, i, t) for c, both in lists.items() for i, t in enumerate(both[k])], "case_id string, idx int, text string")
    got = case_pairs(side(0), side(1), ["case_id"], 0.5).collect()
    for c, (gen, ref) in lists.items():
        own = [r for r in got if r["case_id"] == c]
        assert sum(r["n_pairs"] for r in own) == len(gen) * len(ref)
        score = lambda x, y: min(len(x & y) / len(x), len(x & y) / len(y)) if x and y else 0.0
        every = [score(_toks(g), _toks(r)) for g in gen for r in ref]
        for label, n in (("same", sum(x >= 0.5 for x in every)), ("different", sum(x < 0.5 for x in every))):
            assert sum(r["n_pairs"] for r in own if r["label"] == label) == n
        for r in own:
            if r["g"] is not None:
                assert r["score"] == pytest.approx(score(_toks(gen[r["g"]]), _toks(ref[r["r"]]))) and _toks(gen[r["g"]]) & _toks(ref[r["r"]])
