import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsmith.llm import toxicity

from .conftest import SCHEMA, prose

INSULTS = ["grobnix", "larwit", "quaddle", "snorb"]


@pytest.fixture(scope="module")
def marked(spark):
    """Prose of which a sixth has insults, some in forms seen once only; labels for half."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        words = prose(rng, rng.randrange(8, 120), 3000).split(" ")
        toxic = rng.random() < 1 / 6
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "s", "ing", f"u{rng.randrange(999)}"]))
        rows.append((i, " ".join(words), "en", rng.choice("ab"), 1))
        if i % 2:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def parts_plain(text):
    """Words and marked parts of 3 to 5 bytes."""
    words = {bytes(c | 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())}
    out = {(1, b"<" + w + b">") for w in words}
    for w in words:
        m = b"<" + w + b">"
        out |= {(n, m[i : i + n]) for n in (3, 4, 5) for i in range(len(m) - n + 1)}
    return out


def test_presence_is_of_distinct_parts():
    texts = ["", "a", "Ab ab AB", "x-y Zé1", " \n", "grobnix grobnixes " * 50, "b"]
    row, at = toxicity.presence(texts, 40)
    for i, t in enumerate(texts):
        assert (row == i).sum() == len(parts_plain(t))
    for i, t in enumerate(texts):
        assert np.array_equal(toxicity.presence([t], 40)[1], at[row == i])
    row, at = toxicity.presence(texts, 16)
    w = np.zeros(1 << 16)
    w[at[::3]] = 1
    some = w[at] != 0
    few = toxicity.presence(texts, 16, w)
    assert np.array_equal(few[0], row[some]) and np.array_equal(few[1], at[some])


def step_plain(w, seen, rows, toxic, prior, rate, l1):
    """One step by the risk's definition, coordinate by coordinate."""
    p = [toxicity.sigmoid(sum(w[i] for i in r) + w[-1]) for r in rows]
    n = sum(toxic)
    m = len(rows) - n
    negative = sum(q for q, t in zip(p, toxic, strict=True) if not t) / m - prior * sum(q for q, t in zip(p, toxic, strict=True) if t) / n
    grad = {}
    for r, q, t in zip(rows, p, toxic, strict=True):
        slope = q * (1 - q)
        pull = -prior * slope / n if t else 0
        if negative > 0:
            pull += -prior * slope / n if t else slope / m
        for i in r:
            grad[i] = grad.get(i, 0) + pull
    for i, g in grad.items():
        seen[i] += g * g
        size = rate / seen[i] ** 0.5
        moved = w[i] - size * g
        w[i] = max(abs(moved) - size * l1, 0) * (1 if moved > 0 else -1)


def test_learner_against_the_definition():
    rng = np.random.default_rng(2)
    model = toxicity.Learner(31, 0.2, 0.3, 1e-3)
    w, seen = model.w.copy(), model.seen.copy()
    for _ in range(40):
        rows = [np.unique(rng.integers(0, 30, rng.integers(0, 9))) for _ in range(12)]
        toxic = np.arange(12) % 3 == 0
        model.step(np.repeat(np.arange(12), [len(r) for r in rows]), np.concatenate(rows), toxic)
        step_plain(w, seen, rows, toxic, 0.2, 0.3, 1e-3)
        assert np.allclose(model.w, w, atol=1e-10)


def test_held_out_rows(marked):
    docs, labels = marked
    usable = F.col("doc_id") % 3 != 0
    prior = toxicity.class_prior(labels, "toxic", usable)
    weights = toxicity.train(toxicity.examples(docs, labels, "toxic", usable), prior, bits=18)
    rows = toxicity.score(docs.withColumn("score", F.lit("clash")), weights, bits=18).join(labels.where(~usable), "doc_id").collect()
    guess = np.array([r["score"] >= 0.7 for r in rows])
    truth = np.array([r["toxic"] == 1 for r in rows])
    assert guess[truth].mean() > 0.9 and guess[~truth].mean() < 0.02


def test_bounds_and_odd_tables(spark, marked, odd_docs, no_docs):
    docs, labels = marked
    few = toxicity.examples(docs, labels, "toxic", F.lit(True), max_toxic=20, max_unlabelled=30).collect()
    assert sum(r["toxic"] for r in few) == 20 and sum(not r["toxic"] for r in few) == 30
    again = toxicity.examples(docs.repartition(3), labels, "toxic", F.lit(True), 20, 30).collect()
    assert sorted(map(str, few)) == sorted(map(str, again))
    own = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (1, None), (6, 1), (2, 0), (4, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.class_prior(own, "toxic", F.lit(True)) == pytest.approx(3 / 5)
    rows = toxicity.examples(odd_docs, own, "toxic", F.lit(True))
    toxic = [r["text"] for r in rows.where("toxic").collect()]
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(toxic) == 2 and texts[6] in toxic
    distinct = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert rows.where("NOT toxic").count() == len(distinct)
    weights = toxicity.train(rows, 0.2, bits=12, members=2, steps=5)
    assert np.array_equal(weights, toxicity.train(rows, 0.2, bits=12, members=2, steps=5))
    scored = toxicity.score(odd_docs, weights, bits=12).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert {round(r["score"], 6) for r in scored if not (r["text"] or "").strip()} == {0.2}
    assert toxicity.score(no_docs, weights, bits=12).count() == 0
    none = toxicity.train(toxicity.examples(no_docs, own.limit(0), "toxic", F.lit(True)), toxicity.class_prior(own.limit(0), "toxic", F.lit(True)), bits=12)
    assert {r["score"] for r in toxicity.score(odd_docs, none, bits=12).collect()} == {toxicity.sigmoid(-35.0)}
    alone = toxicity.train(toxicity.examples(odd_docs, own.where("toxic = 0"), "toxic", F.lit(True)), 0.3, bits=12)
    assert {round(r["score"], 6) for r in toxicity.score(odd_docs, alone, bits=12).collect()} == {0.3}


def test_query(spark, marked, odd_docs, tmp_path):
    from evalsmith.llm.queries import QUERIES

    docs, labels = marked
    docs = docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 10_000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op11_nnpu_toxicity"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
