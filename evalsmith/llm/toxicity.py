"""Toxicity: non-negative positive-unlabelled learning over hashed word parts.

Confirmed toxic examples and unlabelled text train logistic classifiers; no
document is taken as clean. With class prior ``pi``, P the toxic examples and
U the unlabelled ones, the risk is

    pi * mean_P loss(+) + max(0, mean_U loss(-) - pi * mean_P loss(-)):

the loss is the sigmoid of the margin's negative, and the toxic share hidden in
U is taken off its risk as negatives. Where a batch has that difference below
zero (the classifier has begun to learn single examples), it counts as zero and
only the risk as positives moves the weights.

A text is the set of its words and of their parts: byte n-grams of 3 to 5 of
the marked word, hashed into ``2^bits`` coordinates, each present or not, so
that a word form not seen before is known by its stem. A classifier has
weights for the coordinates that its toxic examples show significantly more or
less often than its unlabelled texts (a two-sample z of ``screen`` or more);
long clean texts would otherwise gather thousands of small chance weights.
Steps are scaled per coordinate and shrunk towards zero.

At most ``max_toxic`` toxic and ``max_unlabelled`` other texts, those of the
smallest hash, are trained on (bounds and defaults are parameters). Each of
``members`` classifiers gets all toxic examples and its own part of U, in one
Spark task each; scores are of their averaged weights. What reaches the driver
and is broadcast has 2^bits coordinates whatever the input.

Defined results: null and empty texts have the constant only, and so a score;
a document labelled several times is toxic if any label says so; a null label
or id is no label; of rows that share a labelled id the least text is trained
on; repeated rows score alike and are trained on once; texts are read whole;
without toxic examples every score is the prior, and without labels 0. Columns
named like the results are replaced; other columns take no part. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, chunks, store

#: Bytes of text taken apart at a time, and lengths of word parts.
_BYTES, _PARTS = 1 << 21, (3, 4, 5)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
#: ASCII letters in lower case, digits and all bytes of other characters make up words.
_WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def _spread(h: np.ndarray, tag: int, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29)) ^ np.uint64(tag)) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _BASE
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_parts(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, coordinate) of each word itself and of its parts."""
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    stop = np.cumsum([len(w) for w in marked])
    start = np.r_[0, stop[:-1]].astype(np.int64)
    own = np.repeat(np.arange(len(words)), stop - start)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int((stop - start).max()), _BASE)])
    place = np.arange(len(data)) - start[own]
    whole = np.add.reduceat(data * power[place], start)
    at, coordinate = [np.arange(len(words))], [_spread(whole, 1, bits)]
    for n in _PARTS:
        if len(data) < n:
            continue
        h = sum(data[k : len(data) - n + 1 + k] * power[k] for k in range(n)) if len(power) >= n else data[:0]
        inside = np.flatnonzero(place[: len(data) - n + 1] + n <= (stop - start)[own[: len(data) - n + 1]]) if len(h) else np.zeros(0, np.int64)
        at.append(own[inside])
        coordinate.append(_spread(h[inside], n, bits))
    return np.concatenate(at), np.concatenate(coordinate)


def presence(texts: list[str], bits: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of all that is present, rows ascending; with
    ``weights`` only what has one."""
    known: dict[bytes, int] = {}
    rows, words = [], []
    for r, t in enumerate(texts):
        own = set(t.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())
        rows.append(np.full(len(own), r))
        words.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, coordinate = word_parts(list(known), bits)
    if weights is not None:
        some = weights[coordinate] != 0
        word, coordinate = word[some], coordinate[some]
    order = np.argsort(word, kind="stable")
    word, coordinate = word[order], coordinate[order]
    first = np.searchsorted(word, np.arange(len(known) + 1))
    row, used = np.concatenate(rows), np.concatenate(words)
    many = first[used + 1] - first[used]
    at = np.repeat(first[used] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    keys = np.unique((np.repeat(row, many) << bits) | coordinate[at])
    return keys >> bits, keys & ((1 << bits) - 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Learner:
    """A logistic classifier moved by steps scaled per coordinate and shrunk
    towards zero by ``l1``. The last coordinate is the constant; it stays at
    the prior's, so that few examples can't end in calling nothing toxic."""

    def __init__(self, dims: int, prior: float, rate: float, l1: float):
        self.w, self.seen, self.rate, self.l1, self.prior = np.zeros(dims), np.full(dims, 1e-8), rate, l1, prior
        self.w[-1] = np.log(prior / (1 - prior))

    def margins(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.w[at], minlength=n) + self.w[-1]

    def step(self, row: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> None:
        p = sigmoid(self.margins(row, at, len(toxic)))
        positives, others = toxic.sum(), (~toxic).sum()
        negative = p[~toxic].mean() - self.prior * p[toxic].mean()
        slope = p * (1 - p)
        # The risk as positives, and the corrected one as negatives while it is one.
        pull = np.where(toxic, -self.prior * slope / positives, 0)
        if negative > 0:
            pull += np.where(toxic, -self.prior * slope / positives, slope / others)
        i, inverse = np.unique(at, return_inverse=True)
        grad = np.bincount(inverse, weights=pull[row], minlength=len(i))
        self.seen[i] += grad**2
        rate = self.rate / np.sqrt(self.seen[i])
        w = self.w[i] - rate * grad
        self.w[i] = np.sign(w) * np.maximum(np.abs(w) - rate * self.l1, 0)


def screened(present: list[np.ndarray], toxic: np.ndarray, dims: int, least_z: float) -> np.ndarray:
    """Coordinates whose presence differs between toxic and other texts."""
    n, m = toxic.sum(), (~toxic).sum()
    a, b = np.zeros(dims, np.int32), np.zeros(dims, np.int32)
    for p, t in zip(present, toxic, strict=True):
        (a if t else b)[p] += 1
    # Half an example more on either side: no variance is zero.
    share = (a + b + 1) / (n + m + 2)
    z = np.abs(a / n - b / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.flatnonzero(z >= least_z)


def fit(present: list[np.ndarray], toxic: np.ndarray, bits: int, prior: float, screen: float, steps: int, batch: int, rate: float, l1: float) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, weight) learned from the coordinates of each text; the last
    coordinate is the constant. Every batch has its share of both kinds; the
    order is fixed, so a task run again ends alike."""
    kinds = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    chosen = screened(present, toxic, 1 << bits, screen) if len(kinds[0]) and len(kinds[1]) else np.zeros(0, np.int64)
    model, rng = Learner(len(chosen) + 1, prior, rate, l1), np.random.default_rng(0)
    if len(chosen):
        number = np.full(1 << bits, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        held = [(own := number[p])[own >= 0] for p in present]
        batches = max(1, min(len(kinds[0]), len(kinds[1])) // batch)
        for _ in range(-(-steps // batches)):
            order = [rng.permutation(k) for k in kinds]
            for b in range(batches):
                own = np.concatenate([o[b::batches] for o in order])
                row = np.repeat(np.arange(len(own)), [len(held[i]) for i in own])
                model.step(row, np.concatenate([held[i] for i in own]), toxic[own])
    return np.r_[chosen, 1 << bits], model.w


def class_prior(labels: DataFrame, label_col: str, usable: Column) -> float:
    """the toxic share of the usable labelled documents."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & usable)
    return float(own.groupBy("doc_id").agg(F.max(label_col).alias("y")).agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0)


def examples(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, max_toxic: int = 4000, max_unlabelled: int = 8000) -> DataFrame:
    """(text, toxic, __order) of at most ``max_toxic`` confirmed toxic and
    ``max_unlabelled`` unlabelled documents, those of the smallest hash.
    Unlabelled are all usable documents, whether the label table has them or
    not: that is what the prior's correction asks for."""
    order = F.xxhash64(F.lit(11), "doc_id")
    toxic = labels.where(F.col("doc_id").isNotNull() & (F.col(label_col) == 1) & usable).select("doc_id").distinct()
    toxic = toxic.orderBy(order, "doc_id").limit(max_toxic)
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most ``max_toxic`` small rows are broadcast; documents aren't shuffled.
    p = read.join(F.broadcast(toxic), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.lit(True).alias("toxic"), order.alias("__order"))
    rows = read.where(usable).withColumn("__order", F.xxhash64(F.lit(13), "doc_id", "text"))
    # Cut by the hash on slim rows first, so that only the sample's texts move.
    slim = rows.select("__order")
    share = min(1.0, 1.2 * max_unlabelled / max(docs.count(), 1))
    few = slim.where(F.pmod("__order", F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy("__order").limit(max_unlabelled)
    u = rows.join(F.broadcast(few), "__order").dropDuplicates(["__order"]).select("text", F.lit(False).alias("toxic"), "__order")
    return p.unionAll(u)


def train(rows: DataFrame, prior: float, bits: int = 20, members: int = 4, screen: float = 4.0, steps: int = 400, batch: int = 64, rate: float = 0.3, l1: float = 1e-5) -> np.ndarray:
    """Weights (2^bits and the constant) from ``examples`` and the class prior."""
    prior = min(max(prior, 1e-6), 1 - 1e-6) if prior else 0.0
    weights = np.zeros((1 << bits) + 1)
    weights[-1] = np.log(prior / (1 - prior)) if prior else -np.inf
    if not prior:
        return weights

    def parts(texts: pd.Series) -> pd.Series:
        texts, done = [as_text(t) for t in texts], []
        for a, b in chunks([len(t) for t in texts], _BYTES):
            row, at = presence(texts[a:b], bits)
            done += np.split(at.astype(np.int32), np.searchsorted(row, np.arange(1, b - a)))
        return pd.Series(done, dtype=object)

    sample = store(rows.withColumn("present", F.pandas_udf(parts, "array<int>")("text")).drop("text"), "toxic-sample")
    every = F.explode(F.when(F.col("toxic"), F.sequence(F.lit(0), F.lit(members - 1))).otherwise(F.array(F.pmod("__order", F.lit(members)).cast("int"))))

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["toxic", "__order"])
        at, w = fit(list(own["present"]), own["toxic"].to_numpy(bool), bits, prior, screen, steps, batch, rate, l1)
        return pd.DataFrame({"i": at, "w": w})

    learned = sample.withColumn("member", every).groupBy("member").applyInPandas(learn, "i long, w double")
    # Every member gives the constant; the mean is over those that had rows.
    means = store(learned, "toxic-weights")
    constants = means.where(F.col("i") == 1 << bits).count()
    if constants:
        got = means.groupBy("i").agg(F.sum("w").alias("w")).toPandas()
        weights[:] = 0
        weights[got["i"]] = got["w"].to_numpy(float) / constants
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = 20, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; map-only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(texts: pd.Series) -> pd.Series:
        w = shared.value
        texts, done = [as_text(t) for t in texts], []
        for a, b in chunks([len(t) for t in texts], _BYTES):
            row, at = presence(texts[a:b], bits, w)
            done.append(sigmoid(np.bincount(row, weights=w[at], minlength=b - a) + float(w[-1])))
        return pd.Series(np.concatenate(done) if done else np.zeros(0))

    return docs.withColumn(out, F.pandas_udf(run, "double")(text_col))
