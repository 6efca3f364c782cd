"""Quality classifier: logistic regression over hashed word n-grams.

A text's tokens are its runs of word characters and its runs of other
characters. Single tokens and neighbouring pairs hash into ``2^bits``
coordinates; a text is the sparse vector of their counts, scaled to length 1,
plus a constant. The weights are trained with follow-the-regularised-leader
updates, one coordinate at a time with its own rate, and most stay exactly
zero. A score is the sigmoid of the sparse dot product.

Training takes at most ``max_train`` labelled documents, those of the
smallest id hash (the bound and its default are parameters). They are dealt
over a fixed number of shards; each pass trains every shard from the same
state, and the shards' changes are averaged coordinate by coordinate in
Spark. State and weights have 2^bits coordinates whatever the input, which
bounds what reaches the driver and what is broadcast.

Defined results: null and empty texts have the constant only, and so a score;
a document labelled several times has the mean label; a null label or id is
no label; repeated rows score alike; texts are read whole; without labels
every score is 0.5. Columns named like the results are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, store

#: Bytes of text made into vectors at a time.
_BYTES = 1 << 21
_BASE, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Classes of UTF-8 bytes: 0 space, 1 word, 2 other. A part of a character
#: beyond ASCII counts as a word's.
_KIND = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


class Vectors:
    """Sparse rows of hashed n-gram counts, each scaled to length 1."""

    def __init__(self, bits: int):
        self.bits = bits
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, coordinate, value) of all entries, rows ascending."""
        # A blank closes each text, so no token crosses two.
        raws = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
        data = np.frombuffer(b"".join(raws), np.uint8)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        start = edge[kind[edge] > 0]
        if not len(start):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        stop = edge[np.searchsorted(edge, start) + 1]
        hashes = self._hash(data, start, stop)
        row = np.searchsorted(np.cumsum([len(r) for r in raws]), start, side="right")
        follows = np.flatnonzero(row[1:] == row[:-1])
        pairs = hashes[follows] * _PAIR + hashes[follows + 1]
        rows = np.r_[row, row[follows]].astype(np.uint64)
        spread = np.r_[hashes, pairs]
        spread = (spread ^ (spread >> np.uint64(31))) * _PAIR
        keys, count = np.unique((rows << np.uint64(self.bits)) | (spread >> np.uint64(64 - self.bits)), return_counts=True)
        rows = (keys >> np.uint64(self.bits)).astype(np.int64)
        length = np.sqrt(np.bincount(rows, weights=count.astype(float) ** 2, minlength=len(texts)))
        return rows, (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64), count / length[rows]

    def _hash(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) < n + 1:
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE)])
            self.inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _INVERSE)])
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])]
        return (total[stop] - total[start]) * self.inverse[start]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for the logistic loss.
    The last coordinate is the constant; it isn't regularised."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z, rate = self.z[i], (self.beta + np.sqrt(self.n[i])) / self.alpha
        size = np.arange(len(self.z))[i]
        l1 = np.where(size == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / (rate + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - step * w
        self.n[i] += g * g


def train(labelled: DataFrame, bits: int = 18, max_train: int = 20_000, shards: int = 4, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (2^bits and the constant) from rows (doc_id, text, label in 0..1).

    ``labelled`` is sampled down to ``max_train`` rows by id hash, all of
    which the sample keeps if there are no more.
    """
    spark = labelled.sparkSession
    dims = (1 << bits) + 1
    z, n = np.zeros(dims), np.zeros(dims)
    # Written once: the passes read a bounded table, not the corpus.
    sample = store(labelled.select("text", "label", F.pmod("__order", F.lit(shards)).alias("shard"), "__order"), "classifier-sample")
    settings = (alpha, beta, l1, l2)
    for _ in range(passes):
        state = spark.sparkContext.broadcast((z, n))

        def shard_pass(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            z0, n0 = state.value
            model, vectors, seen = Ftrl(z0.copy(), n0.copy(), *settings), Vectors(bits), False
            for f in frames:
                texts, labels = [as_text(t) for t in f["text"]], f["label"].to_numpy(float)
                for a, b in chunks([len(t) for t in texts], _BYTES):
                    rows, at, x = vectors(texts[a:b])
                    cut = np.searchsorted(rows, np.arange(b - a + 1))
                    for r in range(b - a):
                        s = slice(cut[r], cut[r + 1])
                        model.update(np.r_[at[s], dims - 1], np.r_[x[s], 1.0], labels[a + r])
                        seen = True
            if seen:
                moved = np.flatnonzero((model.z != z0) | (model.n != n0))
                yield pd.DataFrame({"i": moved, "dz": model.z[moved] - z0[moved], "dn": model.n[moved] - n0[moved]})

        # In one order, so that a pass run again ends in the same state.
        changes = sample.repartition(shards, "shard").sortWithinPartitions("__order", "label").mapInPandas(shard_pass, "i long, dz double, dn double")
        moved = changes.groupBy("i").agg((F.sum("dz") / shards).alias("dz"), (F.sum("dn") / shards).alias("dn")).toPandas()
        z, n = z.copy(), n.copy()
        z[moved["i"]] += moved["dz"].to_numpy(float)
        n[moved["i"]] += moved["dn"].to_numpy(float)
        state.unpersist()
    return Ftrl(z, n, *settings).weights()


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_train: int = 20_000) -> DataFrame:
    """(doc_id, text, label, __order) of at most ``max_train`` usable labelled
    documents, those of the smallest id hash.

    The label table is cut first, by a threshold on the hash that leaves a
    fifth more than the bound, then exactly. The ids that remain, at most
    ``max_train`` small rows, are broadcast, so documents are not shuffled.
    """
    order = F.xxhash64(F.lit(7), "doc_id")
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("double").alias("label"))
    own = own.where(usable)
    share = min(1.0, 1.2 * max_train / max(own.count(), 1))
    own = own.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    own = own.withColumn("__order", order).orderBy("__order", "doc_id").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")


def score(docs: DataFrame, weights: np.ndarray, bits: int = 18, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(texts: pd.Series) -> pd.Series:
        w, vectors = shared.value, Vectors(bits)
        texts = [as_text(t) for t in texts]
        done = []
        for a, b in chunks([len(t) for t in texts], _BYTES):
            rows, at, x = vectors(texts[a:b])
            done.append(sigmoid(np.bincount(rows, weights=w[at] * x, minlength=b - a) + float(w[-1])))
        return pd.Series(np.concatenate(done) if done else np.zeros(0))

    return docs.withColumn(out, F.pandas_udf(run, "double")(text_col))
