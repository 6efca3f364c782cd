"""Vector candidates over ``embeddings`` (T2 / F10 with a model scorer): rows
whose id is divisible by 50 are the queries, or a label's generated items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nearest import SCALE, fit_cells, nearest, recall_against, vector_candidates
from ..session import store, table

DIMS = 64  # of the given table
K = 10
FLOOR = 0.25


def _vectors(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e, e.where(F.col("vec_id") % 50 == 0)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact route: the best rows of every query, against all rows."""
    rows, queries = _vectors(spark, sf_dir)
    return nearest(rows, queries, "vec_id", "embedding", DIMS, K)


def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact route: pairs to find, and whether it
    reaches nine tenths of them."""
    rows, queries = _vectors(spark, sf_dir)
    cells = fit_cells(rows, "vec_id", "embedding", DIMS, K)
    truth = store(nearest(rows, queries, "vec_id", "embedding", DIMS, K), "nearest-truth")
    r = recall_against(nearest(rows, queries, "vec_id", "embedding", DIMS, K, cells), truth)
    return r.select("n_true", (F.col("n_found") * 10 >= F.col("n_true") * 9).alias("recall_reached"))


def vector_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 for a scorer of vectors: pairs of a label whose cosine reaches the floor."""
    rows, queries = _vectors(spark, sf_dir)
    others = rows.where(F.col("vec_id") % 50 != 0)
    pairs = vector_candidates(queries, others, ["label"], "vec_id", "embedding", DIMS, FLOOR)
    return pairs.select("label", "a", "b", F.round("cosine", 6).alias("cosine"))


QUERIES = {
    "nearest_vectors": nearest_vectors,
    "nearest_recall": nearest_recall,
    "vector_case_pairs": vector_case_pairs,
}

_USABLE = f"""
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
"""


def oracles() -> dict[str, str]:
    exact = f"""
WITH e AS ({_USABLE}), f AS (SELECT vec_id, list_transform(v, lambda x: floor({SCALE} * x)) AS v FROM e),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM f q JOIN f r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s
)
SELECT query_id, id, score, rank FROM ranked WHERE rank <= {K}
"""
    return {
        "nearest_vectors": exact,
        "nearest_recall": f"SELECT count(*) AS n_true, true AS recall_reached FROM ({exact})",
        "vector_case_pairs": f"""
WITH e AS ({_USABLE})
SELECT q.label, q.vec_id AS a, r.vec_id AS b, round(list_cosine_similarity(q.v, r.v), 6) AS cosine
FROM e q JOIN e r ON q.label = r.label WHERE q.vec_id % 50 = 0 AND r.vec_id % 50 <> 0 AND list_cosine_similarity(q.v, r.v) >= {FLOOR}
""",
    }
