"""Hard negatives by threshold joins over an inverted index (L2AP style).

An anchor's positives are the rows of its label with the highest inner
products; the hard negatives of a positive are the highest rows of other
labels whose score lies in a window below the positive's.

Both searches are threshold joins of a set of queries with all rows, in
blocks: rows and queries are dealt into blocks and each pair of blocks meets
in one Spark task. There, for a threshold t on the score:

* dimensions are ordered by how much of the block's length they hold. A row is
  indexed only as far as the rest of it could still lift a product to t: from
  the dimension on whose suffix norm times the longest query falls short, its
  dimensions are left out of the index, and a row short throughout has no
  posting at all;
* partial scores accumulate dimension by dimension, and a pair is dropped as
  soon as its partial score plus the norms of what remains of both is below t;
* pairs that survive are finished from the rows themselves.

A query whose windows are not full at t comes again at a lower threshold,
until they are or t is the windows' lower end. A first round against a sample
of at most ``sample_rows`` rows gives every query a threshold at which its
windows are certain to fill (the sample's rows are rows of the table), so that
blocks give back few more than the result needs. The sample only starts the
search: results are exact and over all rows.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part; components are floored to integers, held between
-2^24 and 2^24; vectors of different lengths count as filled up with zeros, an
empty one scores 0. Every row is one of its own, also if it repeats another:
only itself is not its positive. A null id is no query and stands last among
ties. Ties go to the smaller id. Without rows, positives or negatives in the
window there is nothing to give. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import store

#: Components lie within this, so that products of 2^14 of them are exact.
_MOST = 1 << 24
#: Dimensions accumulated between two prunings, pairs held at a time, and the
#: share of pairs left at which they are followed one by one.
_STEP, _PAIRS, _SPARSE = 8, 1 << 20, 0.125
#: Stands for a null id among ties.
_LAST = np.iinfo(np.int64).max


class Index:
    """An inverted index of the rows of a block for scores of ``least`` or
    more per unit of query length: the rows in order of how far they are
    indexed, so that a dimension's postings are the first rows."""

    def __init__(self, rows: np.ndarray, least: float):
        self.order = np.argsort(-np.einsum("ij,ij->j", rows, rows, dtype=float), kind="stable")
        rows = rows[:, self.order]
        dims = rows.shape[1]
        # rest[r, k]: length of the row from dimension k on, a little over.
        rest = np.sqrt(np.cumsum((rows.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9) + 1e-6
        rest = np.hstack([rest, np.full((len(rows), 1), 1e-6)])
        # The first dimension from which on the row can't reach the threshold.
        depth = (rest[:, :dims] >= least).sum(axis=1)
        depth = -(-depth // _STEP) * _STEP
        depth = np.minimum(depth, dims)
        self.place = np.argsort(-depth, kind="stable")
        self.rows, self.rest, self.depth = rows[self.place], rest[self.place], depth[self.place]
        self.columns = np.ascontiguousarray(self.rows.T.astype(float))
        self.postings = [int(np.searchsorted(-self.depth, -k, side="left")) for k in range(dims)]

    def join(self, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of all pairs with a score of ``least`` of the
        query or more."""
        queries = queries[:, self.order]
        dims = queries.shape[1]
        rest = np.sqrt(np.cumsum((queries.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9) + 1e-6
        rest = np.hstack([rest, np.full((len(queries), 1), 1e-6)])
        # A threshold that nothing scores up to is met by rows without postings too.
        whole = bool((least <= 0).any())
        n = len(self.rows) if whole else self.postings[0]
        at_a_time = max(1, _PAIRS // max(n, 1))
        for start in range(0, len(queries), at_a_time):
            own = slice(start, min(start + at_a_time, len(queries)))
            yield from self._join(queries[own], rest[own], least[own], n, whole, start)

    def _join(self, x: np.ndarray, rest: np.ndarray, least: np.ndarray, n: int, whole: bool, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dims, k = x.shape[1], 0
        partial = np.zeros((len(x), n))
        # Integers of less than 2^53 are exact as floating point numbers.
        small = dims * float(np.abs(x).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) < 2**53
        values, place = x.astype(float), np.arange(n)
        q, r = np.divmod(np.arange(len(x) * n), max(n, 1))
        while k < dims and small:
            end = min(k + _STEP, dims)
            m = n if whole else min(n, self.postings[k])
            partial[:, :m] += values[:, k:end] @ self.columns[k:end, :m]
            k = end
            # What a row has not had added up begins where its postings end.
            to = np.full(n, k) if whole else np.minimum(k, self.depth[:n])
            open_ = partial + rest[:, to] * self.rest[place, to] >= least[:, None]
            if np.count_nonzero(open_) <= _SPARSE * open_.size or k == dims:
                q, r = np.nonzero(open_)
                break
        # Rows have parts left out of the index: pairs are finished from the row.
        for i in range(0, len(q), _PAIRS):
            a, b = q[i : i + _PAIRS], r[i : i + _PAIRS]
            score = np.zeros(len(a), np.int64)
            done = 0
            while done < dims and len(a):
                end = min(done + _STEP, dims)
                score += np.einsum("ij,ij->i", x[a, done:end].astype(np.int64), self.rows[b, done:end].astype(np.int64))
                done = end
                ok = score + rest[a, done] * self.rest[b, done] >= least[a]
                if not ok.all():
                    a, b, score = a[ok], b[ok], score[ok]
            ok = score >= least[a]
            yield a[ok] + start, self.place[b[ok]], score[ok]


def best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each group, by score then tie."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < most]


def fill(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray, certain: np.ndarray, fits: Callable, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): the best ``most`` rows of each window.

    Window w belongs to query ``owner[w]`` and holds scores low[w] to high[w]
    of rows that ``fits`` the query. A query's threshold falls in steps to the
    lower end of its windows until all of them are full; where ``certain`` is
    finite, lower scores aren't looked for.
    """
    found = [np.zeros(0, np.int64)] * 3
    if not len(rows) or not len(low):
        return tuple(found)
    length = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) + 1e-9
    reach = length * (math.sqrt((rows.astype(float) ** 2).sum(axis=1).max()) + 1)
    floor, top = np.full(len(queries), np.inf), np.full(len(queries), -np.inf)
    np.minimum.at(floor, owner, low)
    np.maximum.at(top, owner, high)
    open_ = np.flatnonzero(np.isfinite(top) | (floor < np.inf))
    # No score lies beyond what the longest row can give.
    floor = np.maximum(np.maximum(floor, -reach), certain)
    begin, end = np.minimum(top, 0.75 * reach), np.maximum(floor, 0)
    windows_of = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[windows_of], np.arange(len(queries) + 1))
    for left in (0.75, 0.5, 0.25, 0, -1):
        if not len(open_):
            break
        least = np.maximum(floor, end + left * (begin - end)) if left >= 0 else floor
        least = np.where(np.isfinite(certain), floor, least)
        index = Index(rows, float((least[open_] / length[open_]).min()))
        pairs = list(index.join(queries[open_], least[open_]))
        q, r, s = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        q = open_[q]
        ok = fits(q, r)
        q, r, s = q[ok], r[ok], s[ok]
        # Every window of the query sees the pair.
        many = first[q + 1] - first[q]
        at = np.repeat(np.arange(len(q)), many)
        w = windows_of[np.repeat(first[q] - (np.cumsum(many) - many), many) + np.arange(len(at))]
        ok = (s[at] >= low[w]) & (s[at] <= high[w])
        w, at = w[ok], at[ok]
        keep = best(w, s[at], ids[r[at]], most)
        w, at = w[keep], at[keep]
        unready = np.zeros(len(queries), bool)
        unready[owner[(np.bincount(w, minlength=len(low)) < most) & (least[owner] > low)]] = True
        unready &= least > floor
        ok = ~unready[owner[w]]
        found = [np.concatenate([a, b]) for a, b in zip(found, (w[ok], r[at[ok]], s[at[ok]]), strict=True)]
        open_ = open_[unready[open_]]
    return tuple(found)


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(rid, vec_id, label, v): rows that take part, with integer components."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(label.isNotNull() & F.col("embedding").isNotNull() & fine)
    held = F.transform(x, lambda c: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c)).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), held.alias("v"))


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int32)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def blocks_of(rows: int, parts: int, least: int, most: int) -> int:
    """Blocks of about ``rows / parts`` rows, within bounds."""
    return max(1, -(-rows // min(most, max(least, -(-rows // parts)))))


def search(queries: DataFrame, rows: DataFrame, same_label: bool, most: int, block_rows: tuple[int, int], query_rows: int = 4096) -> DataFrame:
    """(rid, window, score, other, other_id): per query window the best
    ``most`` of each row block. ``queries``: rid, label, v, least (a score
    at which its windows are certain to fill, or null), windows (array of low and high; null: open).
    ``rows``: rid, vec_id, label, v."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    row_blocks = blocks_of(rows.count(), parts, *block_rows)
    query_blocks = blocks_of(queries.count(), 1, query_rows, query_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    left = queries.withColumns({"qb": own(query_blocks)}).withColumn("rb", every(row_blocks))
    right = rows.select("rid", F.coalesce("vec_id", F.lit(_LAST)).alias("tie"), F.col("vec_id").isNotNull().alias("named"), "label", "v")
    right = right.withColumn("rb", own(row_blocks)).withColumn("qb", every(query_blocks))
    cells = max(parts, row_blocks * query_blocks)

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = {"rid": [], "window": [], "score": [], "other": [], "place": []}
        dims = max([1, *(len(v) for v in q["v"]), *(len(v) for v in r["v"])])
        x, y = _matrix(q["v"], dims), _matrix(r["v"], dims)
        rid, other = q["rid"].to_numpy(np.int64), r["rid"].to_numpy(np.int64)
        ids, named = r["tie"].to_numpy(np.int64), r["named"].to_numpy(bool)
        label, other_label = q["label"].to_numpy(np.int64), r["label"].to_numpy(np.int64)
        certain = q["least"].astype(float).fillna(-np.inf).to_numpy()
        size = [len(w) for w in q["windows"]]
        owner = np.repeat(np.arange(len(q)), size)
        number = np.concatenate([np.arange(n) for n in size]) if size else owner
        bounds = [(w["low"], w["high"]) for own_ in q["windows"] for w in own_]
        low = np.array([-np.inf if b[0] is None else b[0] for b in bounds], float)
        high = np.array([np.inf if b[1] is None else b[1] for b in bounds], float)

        def give(qs: np.ndarray, rs: np.ndarray) -> None:
            """Joins the queries ``qs`` with the rows ``rs`` of the block."""
            mine = np.flatnonzero(np.isin(owner, qs))
            to = np.searchsorted(qs, owner[mine])
            fits = (lambda a, b: rid[qs[a]] != other[rs[b]]) if same_label else (lambda a, b: label[qs[a]] != other_label[rs[b]])
            w, at, score = fill(y[rs], ids[rs], x[qs], low[mine], high[mine], to, certain[qs], fits, most)
            w = mine[w]
            for k, v in (("rid", rid[owner[w]]), ("window", number[w]), ("score", score), ("other", other[rs[at]]), ("place", rs[at])):
                out[k].append(v)

        if same_label:
            for v in np.unique(label):
                give(np.flatnonzero(label == v), np.flatnonzero(other_label == v))
        else:
            give(np.arange(len(q)), np.arange(len(r)))
        done = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
        place = done.pop("place").astype(np.int64)
        return pd.DataFrame(done | {"other_id": ids[place], "named": named[place]}).astype({"rid": "int64", "window": "int32", "score": "int64", "other": "int64"})

    # Both sides dealt by number: small blocks aren't merged into few tasks.
    left, right = left.repartition(cells, "qb", "rb"), right.repartition(cells, "qb", "rb")
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, "rid long, window int, score long, other long, other_id long, named boolean")
    return found.withColumn("other_id", F.when(F.col("named"), F.col("other_id"))).drop("named")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each (rid, window), with their 1-based rank."""
    place = Window.partitionBy("rid", "window").orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def filled(queries: DataFrame, rows: DataFrame, sample: DataFrame, same_label: bool, most: int, block_rows: tuple[int, int]) -> DataFrame:
    """The exact first ``most`` of every query window over all rows."""
    early = first_of(search(queries.withColumn("least", F.lit(None).cast("long")), sample, same_label, most, block_rows), most)
    # The threshold at which a window is certain to fill, of the query's least.
    certain = early.where(F.col("rank") == most).groupBy("rid").agg(F.min("score").alias("least"), F.count("*").alias("full"))
    started = queries.join(certain, "rid", "left").withColumn("least", F.when(F.col("full") == F.size("windows"), F.col("least"))).drop("full")
    return first_of(search(store(started, "negatives-started"), rows, same_label, most, block_rows), most)


def mine(
    vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    sample_rows: int = 4096, block_rows: tuple[int, int] = (1024, 65_536),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Negatives score from ``low`` to ``high`` percent of the
    positive. ``vectors`` has vec_id and embedding, ``label`` and ``anchor``
    are over its columns and vec_id."""
    rows = store(quantised(vectors, label, scale), "negatives-rows")
    anchors = rows.where(F.col("vec_id").isNotNull() & anchor)
    share = min(1.0, sample_rows / max(rows.count(), 1))
    sample = store(rows.where(F.pmod(F.xxhash64(F.lit(5), "rid"), F.lit(1 << 30)) < int(share * (1 << 30))), "negatives-sample")
    window = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    none = F.lit(None)
    near = filled(store(anchors.withColumn("windows", F.array(window(none, none))), "negatives-anchors"), rows, sample, True, positives, block_rows)
    near = store(near.select("rid", F.col("other").alias("positive"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")), "negatives-near")
    # Scores that fit, as whole numbers; below zero none does.
    fit = window(F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"(positive_score * {high}) div 100"))
    fitting = near.where(F.col("positive_score") >= 0).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("window", fit.alias("fit")))).alias("w"))
    queries = anchors.join(fitting, "rid").withColumn("windows", F.transform("w", lambda w: w["fit"])).drop("w")
    far = filled(store(queries, "negatives-queries"), rows, sample, False, negatives, block_rows)
    ids = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["rid", "window"]).join(ids, "rid").select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
