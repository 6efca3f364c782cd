"""Running sums and numbering against plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from evalsmith.operators.ordering import numbered_within, running
from evalsmith.session import store


def test_running_sums(spark):
    rows = [(i % 7, i, (i * 37) % 11) for i in range(500)] + [(None, 1, 2)] * 3
    got = running(store(spark.createDataFrame(rows, "k long, i long, n long"), "t"), [F.col("k").asc_nulls_last(), F.col("i")], {"before": "n"}, rows_per_task=40)
    want, total = [], 0
    for at, (k, i, n) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))):
        want.append((at, k, i, total))
        total += n
    assert sorted((r["index"], r["k"], r["i"], r["before"]) for r in got.collect()) == want


def test_numbering_spreads_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 3001) for i in range(3000)] + [(None, 1), (None, 2)]
    got = numbered_within(spark.createDataFrame(rows, "g string, n long"), ["g"], [F.col("n")], "k", rows_per_task=200)
    assert got.columns == ["g", "n", "k"]
    want = Counter()
    expect = []
    for g, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[g] += 1
        expect.append((g or "", n, want[g]))
    assert sorted((r["g"] or "", r["n"], r["k"]) for r in got.collect()) == sorted(expect)
