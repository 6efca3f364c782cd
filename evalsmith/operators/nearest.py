"""Candidate pairs for scorers that read vectors (T2, T3, F10 with a model
scorer): an inverted file of cells with several probes, and exact routes.

The cells are fitted on a bounded sample (``sample_rows`` rows, the least by
the hash of their id); every row is indexed. The probes are the fewest that
reach the asked recall on that sample, so they follow the data rather than a
fixed number. Without cells the same jobs are exact: all rows share one cell.

Scores of ``nearest`` are inner products of components in fixed point
(``floor(scale * x)``), exact in any order of addition. Rows whose vector is
null, of another length than ``dims``, zero, or has a null or non-finite
component take no part. Ids are unique and not null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .joins import join_facts

#: Cells are broadcast: at most so many centroids (8 MB at 512 dimensions).
MAX_CELLS = 4_096
#: Rows of one side that a task holds at once.
CHUNK = 2_048
SCALE = 1_024
_SLICE = 256  # queries scored at once within a chunk


@dataclass(frozen=True)
class Cells:
    """Unit centroids, one a cell, and how many of them a query visits."""

    centroids: np.ndarray
    probes: int


def usable(vec: str, dims: int) -> Column:
    """Whether a vector has ``dims`` finite components that aren't all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dims) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in values])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest_cells(m: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best cells of each row, best first, ties by smaller number."""
    return np.argsort(-(_unit(m) @ centroids.T), axis=1, kind="stable")[:, :n]


def _centroids(units: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Spherical k-means of the sample, from its first ``n`` rows."""
    at = units[:n]
    for _ in range(rounds):
        own = (units @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 0, sums / np.maximum(length, 1e-300), at)
    return at


def _fewest_probes(m: np.ndarray, centroids: np.ndarray, k: int, recall: float, scale: int) -> int:
    """The fewest cells that hold ``recall`` of the true best ``k`` of up to
    256 sample rows among the sample."""
    fixed = np.floor(scale * m)
    score = fixed[:_SLICE] @ fixed.T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(len(m) - 1, 1))]
    rank = np.argsort(_nearest_cells(m[:_SLICE], centroids, len(centroids)), axis=1)
    own = _nearest_cells(m, centroids, 1)[:, 0]
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1


def fit_cells(rows: DataFrame, id_col: str, vec: str, dims: int, k: int = 10, recall: float = 0.95, sample_rows: int = 16_384, rounds: int = 8, scale: int = SCALE) -> Cells | None:
    """Cells and probes for ``rows``; None (the exact route) without a usable row.

    There are about as many cells as the square root of the rows, at most
    ``MAX_CELLS`` and a sixteenth of the sample: half of it fits the cells, the other the probes. Only the sample reaches the driver."""
    good = rows.where(usable(vec, dims))
    sample = good.select(id_col, vec).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()
    if not sample:
        return None
    m = _matrix([r[1] for r in sample])
    # Probes are read off rows that the centroids have not seen, as most rows are.
    seen, unseen = (m[::2], m[1::2]) if len(m) > 16 else (m, m)
    n = max(1, min(int(good.count() ** 0.5), MAX_CELLS, len(seen) // 8))
    centroids = _centroids(_unit(seen), n, rounds)
    return Cells(centroids, _fewest_probes(unseen, centroids, k, recall, scale))


def with_cells(rows: DataFrame, vec: str, cells: Cells | None, n: int = 1, out: str = "cell") -> DataFrame:
    """A row for each of the ``n`` nearest cells of each vector."""
    if cells is None:
        return rows.withColumn(out, F.lit(0))
    held = rows.sparkSession.sparkContext.broadcast(cells.centroids)

    @F.pandas_udf("array<int>")
    def visit(v: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest_cells(_matrix(v), held.value, n).astype(np.int32)) if len(v) else [], dtype=object)

    return rows.withColumn(out, F.explode(visit(vec)))


def _best_of(k: int, scale: int) -> Callable:
    """The best ``k`` rows of a chunk for each query of a chunk."""

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            ids, r = rows["id"].to_numpy(), np.floor(scale * _matrix(rows["v"]))
            for at in range(0, len(queries), _SLICE):
                some = queries.iloc[at : at + _SLICE]
                own = some["query_id"].to_numpy()
                score = np.floor(scale * _matrix(some["v"])) @ r.T
                score[own[:, None] == ids[None, :]] = -np.inf
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                kept = np.take_along_axis(score, order, axis=1)
                i, j = np.nonzero(kept > -np.inf)
                out["query_id"].append(own[i])
                out["id"].append(ids[order[i, j]])
                out["score"].append(kept[i, j].astype(np.int64))
        return pd.DataFrame({c: np.concatenate(v) if v else np.array([], dtype=np.int64) for c, v in out.items()})

    return best


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vec: str, dims: int, k: int, cells: Cells | None = None, chunk: int = CHUNK, scale: int = SCALE) -> DataFrame:
    """(query_id, id, score, rank): the best ``k`` other rows of each query by
    inner product, ties by smaller id; all with ``cells`` None, else those in
    the cells that the query probes.

    A cell's rows and queries are dealt into chunks and each chunk of rows
    meets each chunk of queries in a task of its own, so a cell with a third of
    all rows is no single task. Queries of an empty table, or without a usable
    vector, have no row in the result. Other columns are ignored."""
    bare = lambda df, name: df.where(usable(vec, dims)).select(F.col(id_col).cast("long").alias(name), F.col(vec).alias("v"))
    r = store(with_cells(bare(rows, "id"), "v", cells), "nearest-rows")
    q = store(with_cells(bare(queries, "query_id"), "v", cells, cells.probes if cells else 1), "nearest-queries")
    # One row a cell: at most MAX_CELLS.
    of = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    chunks = F.broadcast(store(of(r, "r_chunks").join(of(q, "q_chunks"), "cell"), "nearest-cells"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = r.join(chunks, "cell").select("cell", deal("id", "r_chunks").alias("rc"), each("q_chunks").alias("qc"), "id", "v")
    q = q.join(chunks, "cell").select("cell", each("r_chunks").alias("rc"), deal("query_id", "q_chunks").alias("qc"), "query_id", "v")
    on = ["cell", "rc", "qc"]
    found = q.groupBy(*on).cogroup(r.groupBy(*on)).applyInPandas(_best_of(k, scale), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (n_true, n_found): pairs of ``truth`` and those among ``found``."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))


def vector_candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], id_col: str, vec: str, dims: int, floor: float, cells: Cells | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, a, b, cosine): pairs of a left and a right item of one case whose
    vectors have a cosine of at least ``floor`` (above zero); all such pairs
    with ``cells`` None, else those that share a probed cell.

    The pairs to give ``score_distinct_pairs`` and ``greedy_pairs`` for a model
    scorer. The right items of a case (and cell) are dealt into chunks that
    each left item visits, so a large case spreads; only pairs that pass leave
    the join. Items with a null key are in no case."""
    if not floor > 0:
        raise ValueError("floor must be above zero: below it every pair of a case would be a candidate")
    keys = list(keys)
    on = keys + (["_cell"] if cells else [])
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("_v", lambda x: x / length)

    def side(df: DataFrame, name: str, n: int) -> DataFrame:
        out = df.where(usable(vec, dims)).select(*keys, F.col(id_col).alias(name), F.transform(vec, lambda x: x.cast("double")).alias("_v"))
        out = with_cells(out, "_v", cells, n, "_cell") if cells else out
        return store(out.withColumn("_v", unit), "candidate-side")

    a, b = side(left, "a", cells.probes if cells else 1), side(right, "b", 1)
    sizes = store(b.groupBy(*on).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n")), "candidate-sizes")
    b = join_facts(b, sizes, on, F.col("b")).withColumn("_chunk", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int")).drop("_n")
    a = join_facts(a, sizes, on, F.col("a")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    dot = F.aggregate(F.zip_with("_v", "_w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b.withColumnRenamed("_v", "_w"), [*on, "_chunk"]).select(*keys, "a", "b", dot.alias("cosine"))
    return pairs.where(F.col("cosine") >= floor)
