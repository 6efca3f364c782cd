"""Vector candidates against plain loops."""

import math

import numpy as np
import pytest

from evalsmith.operators.matching import greedy_pairs
from evalsmith.operators.nearest import SCALE, fit_cells, nearest, recall_against, vector_candidates

DIMS = 8
SCHEMA = "id long, v array<float>, id_2 string, cell int"
ODD = [None, [], [1.0], [0.0] * DIMS, [float("nan")] * DIMS, [None] + [1.0] * (DIMS - 1), [float("inf")] * DIMS]


def _points(n, spread=0.15, centres=12, seed=7):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, DIMS))
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, DIMS))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()


def _frame(spark, vectors):
    """Rows with columns named like the operator's own."""
    return spark.createDataFrame([(i, v, "x", -1) for i, v in enumerate(vectors)], SCHEMA)


def _plain(vectors, queries, k):
    fixed = {i: [math.floor(SCALE * x) for x in v] for i, v in enumerate(vectors) if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in queries:
        if q in fixed:
            scored = sorted((-sum(x * y for x, y in zip(fixed[q], fixed[i])), i) for i in fixed if i != q)
            out |= {(q, i, -s, rank + 1) for rank, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("chunk", [7, 2_048])
def test_exact_route_equals_the_loop(spark, chunk):
    vectors = _points(150) + ODD + _points(1) * 9  # repeated vectors tie
    df = _frame(spark, vectors)
    got = nearest(df, df.where("id % 5 = 0"), "id", "v", DIMS, 4, chunk=chunk).select("query_id", "id", "score", "rank")
    assert {tuple(r) for r in got.collect()} == _plain(vectors, range(0, len(vectors), 5), 4)


def test_fewer_rows_than_asked_and_empty_tables(spark):
    df = _frame(spark, _points(3))
    assert nearest(df, df, "id", "v", DIMS, 10).count() == 6
    none = df.where("id < 0")
    assert fit_cells(none, "id", "v", DIMS) is None
    assert nearest(none, df, "id", "v", DIMS, 10).count() == 0
    assert nearest(df, none, "id", "v", DIMS, 10).count() == 0


@pytest.mark.parametrize("spread", [0.15, 3.0])
def test_probes_follow_the_data(spark, spread):
    """Nine tenths of the true neighbours, on clustered and on shapeless data."""
    df = _frame(spark, _points(3_000, spread) + ODD)
    cells = fit_cells(df, "id", "v", DIMS, 5, sample_rows=1_000)
    assert len(cells.centroids) == 54 and 1 <= cells.probes <= 54
    queries = df.where("id % 50 = 0")
    truth = nearest(df, queries, "id", "v", DIMS, 5)
    r = recall_against(nearest(df, queries, "id", "v", DIMS, 5, cells, chunk=50), truth).first()
    assert r["n_true"] == 300 and r["n_found"] >= 270
    if spread < 1:
        assert cells.probes < 30


def _items(spark, vectors, sides):
    rows = [(i % 3 if i % 11 else None, i, v, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "case long, idx int, v array<float>, _n string")
    return df.where(f"idx % {sides} = 0"), df.where(f"idx % {sides} <> 0")


@pytest.mark.parametrize("chunk", [5, 2_048])
def test_case_candidates_equal_the_loop(spark, chunk):
    vectors = _points(120) + ODD
    left, right = _items(spark, vectors, 4)
    got = {(r["case"], r["a"], r["b"]) for r in vector_candidates(left, right, ["case"], "idx", "v", DIMS, 0.9, chunk=chunk).collect()}
    good = {i: np.array(v, float) for i, v in enumerate(vectors[:120]) if i % 11}
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(a % 3, a, b) for a in good for b in good if a % 4 == 0 and b % 4 and a % 3 == b % 3 and cos(good[a], good[b]) >= 0.9}
    assert got == want and want
    with pytest.raises(ValueError):
        vector_candidates(left, right, ["case"], "idx", "v", DIMS, 0.0)


def test_greedy_match_on_indexed_candidates(spark):
    """On clustered vectors the index brings what the exact route brings, so
    greedy matching by a vector scorer takes the same pairs."""
    left, right = _items(spark, _points(400, 0.02), 2)
    cells = fit_cells(left.unionByName(right), "idx", "v", DIMS, 5)
    taken = []
    for c in (None, cells):
        edges = vector_candidates(left, right, ["case"], "idx", "v", DIMS, 0.95, c).withColumnsRenamed({"a": "g", "b": "r", "cosine": "score"})
        taken.append({(r["case"], r["g"], r["r"]) for r in greedy_pairs(edges, ["case"], 0.95).collect()})
    assert taken[0] and len(taken[0] & taken[1]) >= 0.9 * len(taken[0])
