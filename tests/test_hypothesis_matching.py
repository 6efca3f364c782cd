"""Hypothesis-generated tie-heavy edge sets: greedy matching (both paths)
and keep-first de-duplication against the plain loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evalsmith.operators.matching import greedy_match, semantic_dedup

from .test_matching import py_dedup, py_greedy

SCORES = st.sampled_from([0.25, 0.5, 0.5, 0.75, 1.0])
EDGES = st.lists(
    st.tuples(st.integers(0, 30), st.integers(0, 4), st.integers(0, 4), SCORES), min_size=0, max_size=300, unique_by=lambda e: e[:3]
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(EDGES)
def test_greedy_matches_loop(spark, edges):
    rows = [(f"c{c}", g, r, float(s)) for c, g, r, s in edges] or [("c9", 0, 0, 0.1)]
    df = spark.createDataFrame(rows, "case_id string, g int, r int, score double")
    by_case = {}
    for c, g, r, s in rows:
        by_case.setdefault(c, []).append((g, r, s))
    got = {}
    for row in greedy_match(df, ["case_id"], 0.5).collect():
        got.setdefault(row["case_id"], []).append((row["ord"], row["g"], row["r"]))
    for c, es in by_case.items():
        assert [(g, r) for _, g, r in sorted(got.get(c, []))] == py_greedy(es, 0.5)


PAIRS = st.lists(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20), min_size=20, max_size=60)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS)
def test_dedup_matches_loop(spark, cases):
    by_case = {f"k{c}": {(min(a, b), max(a, b)) for a, b in pairs if a != b} for c, pairs in enumerate(cases)}
    items = spark.createDataFrame([(k, i, f"t{i}") for k in by_case for i in range(8)], "case_id string, idx int, text string")
    edges = spark.createDataFrame([(k, a, b) for k, es in by_case.items() for a, b in sorted(es)] or [("z", 0, 1)], "case_id string, a int, b int")
    got = {k: set() for k in by_case}
    for r in semantic_dedup(items, ["case_id"], 0.5, edges=edges).where("status = 'kept'").collect():
        got[r["case_id"]].add(r["idx"])
    for k, es in by_case.items():
        assert got[k] == set(py_dedup(list(range(8)), lambda i, j, es=es: (i, j) in es)[0])
