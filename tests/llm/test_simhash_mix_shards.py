"""SimHash joins, mixing, sharding and the pipeline against plain versions."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalsmith.llm import common, hilbert, mixing, simhash

from .conftest import SCHEMA, prose


def fingerprint_plain(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def groups_plain(values, max_bits=3):
    """Smallest index reachable, for each distinct value."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(values)), 2):
        if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= max_bits:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(values))]


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        if len(r["text"] or "") < 10_000:
            assert simhash.fingerprint(r["text"] or "") == fingerprint_plain(r["text"])


def near_values(rng, n):
    """Clusters of values few bits apart, chains and strangers."""
    out = [0, -1, 1, 7, 15]
    for _ in range(n // 20):
        x = rng.getrandbits(64)
        for _ in range(12):
            for k in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << k
            out.append(x - (1 << 64) if x >> 63 else x)
        out += [v - (1 << 64) if v >> 63 else v for v in (rng.getrandbits(64) for _ in range(8))]
    return sorted(set(out))


@pytest.mark.parametrize("max_bits", [1, 3])
def test_trie_join_links_all(max_bits):
    rng = random.Random(4)
    values = near_values(rng, 400)
    forest = simhash.Forest(len(values))
    keys = np.array([v % 2**64 for v in values], np.uint64)
    width = 64 // (max_bits + 1)
    for b in range(max_bits + 1):
        s = np.uint64(b * width % 64)
        turned = keys if s == 0 else (keys << s) | (keys >> (np.uint64(64) - s))
        order = np.argsort(turned)
        simhash.trie_links(turned[order], np.zeros(len(order), np.int64), order, forest, width, max_bits)
    assert forest.label.tolist() == groups_plain(values, max_bits)


@pytest.mark.parametrize("task_rows, least_group", [(100_000, 1024), (400, 40)])
def test_components_equal_all_pairs(spark, task_rows, least_group):
    rng = random.Random(6)
    values = near_values(rng, 300)
    # One block value that many share, some near and some not.
    hot = rng.getrandbits(16)
    more = [hot << 48 | rng.getrandbits(48) & rng.getrandbits(48) & rng.getrandbits(48) for _ in range(300)]
    values = sorted({*values, *(v - (1 << 64) if v >> 63 else v for v in more)})
    fps = common.store(spark.createDataFrame([(v,) for v in values], "fp long"), "t")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(fps, 3, task_rows, least_group)).collect()}
    want = groups_plain(values)
    assert [roots.get(v, v) for v in values] == [values[i] for i in want]


def components_plain(docs):
    values = sorted({fingerprint_plain(r["text"]) for r in docs})
    group = dict(zip(values, groups_plain(values), strict=True))
    first = defaultdict(lambda: None)
    for r in docs:
        g = group[fingerprint_plain(r["text"])]
        if r["doc_id"] is not None and (first[g] is None or r["doc_id"] < first[g]):
            first[g] = r["doc_id"]
    return group, first


def test_near_duplicates_of_odd_tables(odd_docs, no_docs):
    small = odd_docs.where("length(coalesce(text, '')) < 10000")
    docs = small.collect()
    group, first = components_plain(docs)
    want = sorted((r["doc_id"] or -1, fp := fingerprint_plain(r["text"]), first[group[fp]]) for r in docs)
    got = simhash.near_duplicates(small.withColumn("fp", F.lit("clash")).withColumn("root", F.lit("clash")))
    assert sorted((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in got.collect()) == want
    kept = simhash.keep_first(small).collect()
    assert len({group[fingerprint_plain(r["text"])] for r in kept}) == len(kept) == len(set(group.values()))
    for r in kept:
        assert r["doc_id"] == first[group[fingerprint_plain(r["text"])]]
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_first(no_docs).count() == 0


def targets_plain(sizes, weights=(5, 2, 1), share=1.5, repeat=2.0):
    """Shares by weight; the excess over the caps shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= repeat * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = repeat * sizes[s]
            rest -= out[s]
        open_ -= full
    return out


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("broadcast_sources", [10_000, 0])
def test_mix_reaches_its_targets(spark, odd_docs, broadcast_sources):
    rng = random.Random(12)
    more = [(10_000 + i, prose(rng, rng.randrange(0, 60)), "en", rng.choice(["hot"] * 6 + [f"s{k}" for k in range(9)]), 0) for i in range(1500)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, SCHEMA)).withColumn("mix", F.lit("clash")).withColumn("size", F.lit("clash"))
    rows, plan = mixing.plan_mix(docs, broadcast_sources=broadcast_sources)
    got = mixing.mixed(rows, plan, F.col("h"), broadcast_sources=broadcast_sources).collect()
    assert len(got) == docs.count()
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        n = word_count(r["text"])
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = targets_plain(sizes)
    for r in got:
        m = r["mix"]
        assert m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(want[r["source"]])
        assert 0 <= m["copies"] <= 2 and len(m["times"]) == m["copies"]
        assert all(0 <= t <= 1 for t in m["times"]) and m["times"] == sorted(m["times"])
        taken[r["source"]] += m["copies"] * r["size"]
    for s in sizes:
        # Rows equal in doc_id and text, three of the fixture's, stand together.
        assert abs(taken[s] - want[s]) <= 1.5 * largest[s] + 1
    again = mixing.mixed(*(lambda rp: (rp[0], rp[1]))(mixing.plan_mix(docs.repartition(7), broadcast_sources=broadcast_sources)), F.col("h")).collect()
    key = lambda r: (r["doc_id"] or -1, r["h"], r["mix"]["copies"], tuple(r["mix"]["times"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_curriculum_follows_the_schedules(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, prose(rng, 20), "en", "abc"[i % 3], 0) for i in range(3000)], SCHEMA)
    rows, plan = mixing.plan_mix(docs, weights=(1.0, 1.0, 1.0), share=1.0)
    out = mixing.mixed(rows, plan, F.col("h")).select("source", F.explode("mix.times").alias("t")).collect()
    for place, s in enumerate("abc"):
        t = sorted(r["t"] for r in out if r["source"] == s)
        v = mixing.SCHEDULES[place]
        half = (v[0] + v[1]) / (v[0] + 2 * v[1] + v[2])  # of the integral lies before the middle
        assert len(t) == pytest.approx(1000, abs=2)
        assert sum(x < 0.5 for x in t) / len(t) == pytest.approx(half, abs=0.03)
    order = mixing.curriculum(docs, weights=(1.0, 1.0, 1.0), share=1.0)
    assert order.columns == docs.columns and order.count() == pytest.approx(3000, abs=4)


def time_plain(q, knots):
    """Time at which the share q of a schedule's integral lies before, by halving."""
    n = len(knots) - 1

    def area(t):
        k = min(int(t * n), n - 1)
        x = t * n - k
        whole = sum((a + b) / 2 for a, b in zip(knots[:k], knots[1:], strict=False))
        return whole + knots[k] * x + (knots[k + 1] - knots[k]) * x * x / 2

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if area(mid) < q * area(1.0) else (lo, mid)
    return lo


def test_times_are_the_exact_inverse(spark):
    """Also behind documents of very many words in a small source."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 5000 if i % 50 == 0 else 20), "en", "small" if i % 6 == 0 else "large", 0) for i in range(600)], SCHEMA)
    rows, plan = mixing.plan_mix(docs)
    got = mixing.mixed(rows, plan, F.col("h")).collect()
    for place, source in enumerate(["large", "small"]):
        own = sorted((r for r in got if r["source"] == source), key=lambda r: r["h"] % (1 << 64))
        before = 0
        for r in own:
            for copy, t in enumerate(r["mix"]["times"]):
                q = min((before + copy * r["mix"]["source_size"]) / r["mix"]["target"], 1.0)
                assert t == pytest.approx(time_plain(q, mixing.SCHEDULES[place]), abs=1e-6)
            before += r["size"]
    # The sorted copies are those of the rows, in the order of their times.
    line = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    times = sorted((t, r["doc_id"]) for r in got for t in r["mix"]["times"])
    assert sorted(line) == sorted(d for _, d in times)
    at = {}
    for t, d in times:
        at.setdefault(d, []).append(t)
    seen, last = defaultdict(int), -1.0
    for d in line:
        t = at[d][seen[d]]
        seen[d] += 1
        assert t >= last - 1e-12
        last = t


def test_mix_of_no_documents(no_docs):
    rows, plan = mixing.plan_mix(no_docs)
    assert mixing.mixed(rows, plan, F.col("h")).count() == 0
    assert mixing.curriculum(no_docs).count() == 0


@pytest.mark.parametrize("n, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    points = spark.range(1 << n * bits).select(*[F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"x{k}") for k in range(n)])
    rows = points.select("*", hilbert.hilbert_index([F.col(f"x{k}") for k in range(n)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(1 << n * bits))
    for a, b in itertools.pairwise(rows):
        assert sum(abs(a[f"x{k}"] - b[f"x{k}"]) for k in range(n)) == 1


def test_shards_are_runs_of_the_curve(odd_docs, no_docs):
    shards = 7
    got = hilbert.shard_by_curve(odd_docs.withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash")), shards=shards).collect()
    docs = odd_docs.collect()
    key = lambda d, t: (d or -1, len((t or "").encode()) + 16)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted(key(r["doc_id"], r["text"]) for r in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert {len(v) for v in by.values()} <= {len(got) // shards, -(-len(got) // shards)}
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in line] == sorted(r["curve_index"] for r in line)
    assert hilbert.shard_by_curve(no_docs).count() == 0
    assert sorted(r["slot"] for r in hilbert.shard_by_curve(odd_docs.limit(3)).collect()) == [0, 0, 0]


@pytest.mark.parametrize("names", [
    [f"src{i}" for i in range(20)] + ["hot", "", None], [f"src{i}" for i in range(100)] + ["hot"], ["zh-CN", "zh-TW", "zh", "en"], ["Вики", "Весть", "新闻", "新书", "日报", "éa", "ea"],
])
def test_every_value_has_a_place_on_the_curve(spark, names):
    rows = [(i, "same text", "en", names[i % len(names)], 9) for i in range(4 * len(names))]
    got = hilbert.shard_by_curve(spark.createDataFrame(rows, SCHEMA), shards=len(names), text_dims=("source",)).collect()
    place = {r["dim_source"]: r["curve_index"] for r in got}
    assert len(set(place.values())) == len(names) == len({(r["dim_source"], r["curve_index"]) for r in got})
    # As many shards as sources, and as many rows of each: no shard spans two.
    assert len({(r["shard"], r["dim_source"]) for r in got}) == len(names)


def test_text_steps_keep_the_order_by_either_join(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", None, "", "zz"] + [f"v{k}" for k in range(50)]), i) for i in range(900)]
    docs = common.store(spark.createDataFrame(rows, "doc_id long, v string, text_crc32 long"), "test-steps")
    few, many = (hilbert.text_steps(docs.withColumn("w", F.lit("x")), {"w": "one", "v": "step"}, 5, broadcast_keys=k).collect() for k in (100, 10))
    assert sorted(few, key=str) == sorted(many, key=str) and len(few) == len(rows)
    line = sorted(((r["v"] is not None, r["v"] or "", r["step"]) for r in few))
    assert [x[2] for x in line] == sorted(x[2] for x in line) and 0 <= line[0][2] and line[-1][2] < 32
    assert max(Counter(x[2] for x in line).values()) < 3 * len(rows) / 32
