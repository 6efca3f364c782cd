import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsmith.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def mined_plain(rows, positives=5, negatives=10):
    """Hard negatives by comparing every anchor with every row."""
    own = [r for r in rows if r["label"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    own = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] is not None and r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in own]
    last = lambda i: (i is None, i or 0)
    out = []
    for i, (a, label, v) in enumerate(own):
        if a is None or a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), last(b), b, other) for j, (b, other, w) in enumerate(own) if j != i]
        scores.sort(key=lambda s: s[:2])
        for p in [s for s in scores if s[3] == label][:positives]:
            fit = [s for s in scores if s[3] != label and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]]
            out += [(a, p[2], k + 1, s[2], -p[0], -s[0]) for k, s in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def mined(rows, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(rows, label, F.col("vec_id") % 100 == 0, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def odd_vectors(spark, n=700, dims=24):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.2) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    hot = [rng.gauss(0, 0.25) for _ in range(dims)]
    rows += [(n + i, hot, 1) for i in range(150)] + [(5000, hot, 1), (5000, hot, 1), (6000, hot, 9)]
    rows += [
        (None, hot, 2), (None, None, None), (7000, None, 1), (7100, hot, None), (7200, [float("nan")] * dims, 1), (7300, [float("inf")] * dims, 1), (7400, [None] * dims, 1),
        (7500, [], 1), (7600, [0.5, 0.25], 1), (7700, [0.0] * dims, 3), (7800, [-x for x in hot], 1), (7900, hot + [1.0, 2.0], 2), (8000, hot, 77), (8100, [3000.0 * x for x in hot], 1), (-100, hot, 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("how", [{}, {"sample_rows": 40, "block_rows": (16, 64)}, {"sample_rows": 1, "block_rows": (100, 100)}])
def test_against_every_pair(spark, how):
    rows = odd_vectors(spark)
    assert mined(rows, **how) == mined_plain(rows.collect())


def test_clashing_columns_and_few_rows(spark):
    rows = odd_vectors(spark, 300)
    clash = rows.selectExpr("*", "1 AS rid", "2 AS score", "3 AS rank", "'x' AS v", "4 AS least")
    assert mined(clash) == mined(rows)
    assert mined(rows.limit(0)) == [] and mined(rows.where("vec_id = 100")) == []
    assert mined(rows.where("vec_id % 7 != 0").withColumn("label", F.lit(1))) == []


@pytest.mark.parametrize("least", [-1e9, -50.0, 0.0, 20.0, 400.0, 1e7])
@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_threshold_join_finds_all_pairs(least, scale):
    rng = np.random.default_rng(3)
    rows = (rng.normal(0, 12, (300, 37)) * rng.random((300, 1)) ** 3).astype(np.int32) * scale
    rows[5] = 0
    queries = rng.normal(0, 12, (40, 37)).astype(np.int32)
    least = np.full(40, least) * rng.random(40) * scale
    index = hard_negatives.Index(rows, float((least / np.sqrt((queries.astype(float) ** 2).sum(axis=1))).min()))
    got = {(int(q), int(r)): int(s) for a in index.join(queries, least) for q, r, s in zip(*a, strict=True)}
    scores = queries.astype(np.int64) @ rows.astype(np.int64).T
    assert got == {(q, r): int(scores[q, r]) for q, r in zip(*np.nonzero(scores >= least[:, None]), strict=True)}


def test_index_leaves_out_what_cannot_reach():
    rows = np.zeros((4, 16), np.int32)
    rows[:, 0] = [100, 50, 3, 0]
    rows[:, 9] = 1
    index = hard_negatives.Index(rows, 10.0)
    assert index.postings[0] == 2 and index.postings[8] == 0
    assert hard_negatives.Index(rows, 0.5).postings[0] == 4


def test_query(spark, tmp_path):
    from evalsmith.llm.queries import QUERIES

    rows = odd_vectors(spark, 400)
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op12_l2ap_negatives"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == mined_plain(rows.collect())
