"""Source divergence audit: where a source's vocabulary departs from its language's.

Documents fall into (language, source) groups. A language keeps the terms that
occur in at least ``least_docs`` of its documents. Each group, and the language
as a whole, gives a kept term the smoothed share
``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` and two shares diverge by
``floor((p - q)^2 / (p + q))``. The audit lists, per group, the terms that it
uses more than its language does, and every other source of the language by
the divergence summed over all kept terms.

Late string materialization: terms travel as 64-bit digests. One scan counts
documents by language and digest, which gives the vocabulary, and sets every
term's text down beside its digest; a second counts occurrences by group and
keeps, before anything is shuffled, what belongs to the vocabulary. Of texts
only the least and the greatest of a kept digest are shuffled: where these
differ, two terms share the digest, and it is counted anew by text and its
terms numbered apart (``sub``). Text is joined back only to the terms that the
result lists.

The divergence of two sources needs no row per pair and term: a term that
neither has adds the same to all; one that one has is counted by how often it
occurs there; only terms of both are paired, inside the task that holds the
term's groups, which returns sums.

Defined results: null text, language and source are read as empty; a text
without terms counts for its group, which appears with shares of the unseen; a
language without kept terms has divergence 0 and no term rows; repeated rows
are documents of their own; texts are read whole; ties rank by the UTF-8 order
of the item; other columns, whatever their names, take no part; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_facts
from .common import as_text, shuffle_partitions, store

#: Terms counted before they are given out, rows given out at a time, rows of
#: term lists paired at a time, and digests (two numbers each) that a broadcast
#: may hold.
_HELD, _ROWS, _PAIRED, _BROADCAST = 400_000, 1 << 16, 1 << 18, 1_000_000
#: ASCII letters in lower case and all bytes of other characters make up terms.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _digests(words: list[bytes], bits: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - bits)).view(np.int64)


def count_terms(docs: DataFrame, columns: list[str], bits: int = 64) -> DataFrame:
    """(lid, gid, digest, then of n, df and term what ``columns`` names) from
    (lid, gid, text), counted within each task; map-only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], dict[str, Counter]] = {}

        def given() -> Iterator[pd.DataFrame]:
            first = [next(iter(c.values())) for c in held.values()]
            words = [w for c in first for w in c]
            size = [len(c) for c in first]
            rows = {"lid": np.repeat([g[0] for g in held], size), "gid": np.repeat([g[1] for g in held], size), "digest": _digests(words, bits)}
            for c in columns:
                if c == "term":
                    rows[c] = [w.decode("utf-8", "surrogatepass") for w in words]
                else:
                    # Both count the same terms, each in its own order.
                    own = (n for f, k in zip(first, held.values(), strict=True) for n in (f.values() if k[c] is f else map(k[c].__getitem__, f)))
                    rows[c] = np.fromiter(own, np.int64, len(words))
            held.clear()
            for i in range(0, len(words), _ROWS):
                yield pd.DataFrame({k: v[i : i + _ROWS] for k, v in rows.items()})

        total = 0
        for f in frames:
            for lid, gid, text in zip(f["lid"], f["gid"], f["text"], strict=True):
                words = terms_of(as_text(text))
                if not words:
                    continue
                counts = held.setdefault((lid, gid), {c: Counter() for c in columns if c != "term"})
                for c, own in counts.items():
                    total -= len(own)
                    own.update(words if c == "n" else set(words))
                    total += len(own)
                if total >= _HELD:
                    yield from given()
                    total = 0
        yield from given()

    kinds = {"n": "n long", "df": "df long", "term": "term string"}
    return docs.mapInPandas(run, ", ".join(["lid long, gid long, digest long", *[kinds[c] for c in columns]]))


def share(count: str | Column, total: str, terms: str) -> Column:
    """p of a count, exact for counts beyond 64 bits' tenth digit."""
    c = (F.col(count) if isinstance(count, str) else count).cast("decimal(18,0)")
    of = (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")
    return F.when(of > 0, F.call_function("div", (c + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), of)).otherwise(0).cast("long") + 1


def apart(p: str, q: str) -> Column:
    """The divergence of two shares; at most 2 x 10^9."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _among(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``facts``. Tasks count before this join, so no
    key repeats beyond tasks times groups: what isn't broadcast needs no salt."""
    few = facts.limit(_BROADCAST + 1).count() <= _BROADCAST
    return rows.join(F.broadcast(facts) if few else facts, keys)


def _by_group(counts: DataFrame, key: list[str]) -> DataFrame:
    """(lid, gid, key.., n, ln, first): ln is the language's count and
    ``first`` marks one row a term."""
    term = Window.partitionBy("lid", *key)
    counts = counts.groupBy("lid", "gid", *key).agg(F.sum("n").alias("n"))
    return counts.withColumns({"ln": F.sum("n").over(term), "first": F.min("gid").over(term) == F.col("gid")})


def vocabulary(docs: DataFrame, least_docs: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The kept terms' counts by (lid, gid, digest, sub), and (lid, digest,
    sub, term) of them all, from (lid, gid, text)."""
    spark = docs.sparkSession
    told = store(count_terms(docs.withColumn("gid", F.col("lid")), ["df", "term"], bits).drop("gid"), "terms-told")
    # Two rare terms that share a digest may come in together; a term that
    # belongs to the vocabulary always does.
    found = told.groupBy("lid", "digest").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    digests = store(found.select("lid", "digest"), "terms-digests")
    # Dealt by digest: the sums by group and by language share one shuffle of
    # fixed-width rows.
    slim = _among(count_terms(docs, ["n"], bits), digests, ["lid", "digest"])
    slim = slim.repartition(shuffle_partitions(spark, told.count(), 1_000_000), "digest")
    kept = store(_by_group(slim, ["digest"]), "terms-kept")
    spelled = _among(told, digests, ["lid", "digest"]).groupBy("lid", "digest").agg(F.min("term").alias("term"), F.max("term").alias("last"))
    spelled = store(spelled, "terms-spelled")
    shared = store(spelled.where("term != last").select("lid", "digest"), "terms-shared")
    names = spelled.where("term = last").select("lid", "digest", F.lit(0).alias("sub"), "term")
    kept = kept.withColumn("sub", F.lit(0))
    if shared.isEmpty():
        return kept, names
    rows = store(_among(count_terms(docs, ["n", "df", "term"], bits), shared, ["lid", "digest"]), "terms-split")
    place = F.row_number().over(Window.partitionBy("lid", "digest").orderBy("term")).cast("int")
    split = rows.groupBy("lid", "digest", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least_docs)
    split = store(split.select("lid", "digest", "term", place.alias("sub")), "terms-names")
    anew = _by_group(_among(rows, split, ["lid", "digest", "term"]), ["digest", "sub"])
    sole = kept.join(shared, ["lid", "digest"], "left_anti")
    return store(sole.unionByName(anew), "terms-apart"), names.unionByName(split.select("lid", "digest", "sub", "term"))


def _common(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, value): summed over the terms that both have, their divergence
    less what the counts of one and the shares of the unseen have added.
    Rows come sorted by term; one term's rows may span frames."""

    def paired(f: pd.DataFrame) -> pd.DataFrame:
        term = f.groupby(["lid", "digest", "sub"], sort=False).ngroup().to_numpy()
        gid, p, z = (f[c].to_numpy(np.int64) for c in ("gid", "p", "p0"))
        apart_ = lambda x, y: (x - y) * (x - y) // (x + y)
        sums, d = [], 0
        while (d := d + 1) < len(f):
            i = np.flatnonzero(term[d:] == term[:-d])
            if not len(i):
                break
            j = i + d
            value = apart_(p[i], p[j]) - apart_(p[i], z[j]) - apart_(z[i], p[j]) + apart_(z[i], z[j])
            sums.append(pd.DataFrame({"a": gid[i], "b": gid[j], "value": value}).groupby(["a", "b"], as_index=False).sum())
        return pd.concat(sums).groupby(["a", "b"], as_index=False).sum() if sums else pd.DataFrame({"a": [], "b": [], "value": []}, dtype="int64")

    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        if len(held) < _PAIRED:
            continue
        last = held.iloc[-1]
        whole = ~((held["digest"] == last["digest"]) & (held["sub"] == last["sub"]) & (held["lid"] == last["lid"]))
        yield paired(held[whole])
        held = held[~whole]
    if held is not None and len(held):
        yield paired(held)


def pair_sums(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """(a, b, value) for every two groups a < b of a language."""
    spark = kept.sparkSession
    side = lambda s, *extra: stats.select("lid", F.col("gid").alias(s), F.col("p0").alias(f"z{s}"), *extra)
    two = side("a", "terms").join(side("b"), "lid").where("a < b")
    unseen = two.select("a", "b", (F.col("terms") * apart("za", "zb")).alias("value"))
    # Terms that one group has: by its counts, dealt over tasks by a salt.
    salts = 16
    counts = kept.groupBy("lid", "gid", "p", "p0").agg(F.count("*").alias("times")).withColumn("salt", F.pmod(F.xxhash64("gid", "p"), F.lit(salts)))
    others = stats.select("lid", F.col("gid").alias("h"), F.col("p0").alias("zh"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    one = counts.join(others, ["lid", "salt"]).where("gid != h")
    one = one.select(F.least("gid", "h").alias("a"), F.greatest("gid", "h").alias("b"), (F.col("times") * (apart("p", "zh") - apart("p0", "zh"))).alias("value"))
    term = ["lid", "digest", "sub"]
    parts = shuffle_partitions(spark, kept.count(), 500_000)
    dealt = kept.select(*term, "gid", "p", "p0").repartition(parts, *term).sortWithinPartitions(*term, "gid")
    both = dealt.mapInPandas(_common, "a long, b long, value long")
    return unseen.unionAll(one).unionAll(both).groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``term`` lists a group's
    ``top`` terms above its language, part ``pair`` all other sources of the
    language. ``bits`` narrows the digest (tests force collisions with it)."""
    read = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(read("lang"), read("source"), read("text"))
    number = F.monotonically_increasing_id()
    langs = store(docs.select("lang").distinct().withColumn("lid", number), "audit-langs")
    groups = store(join_facts(docs.select("lang", "source").distinct(), langs, ["lang"], F.col("source")).withColumn("gid", number), "audit-groups")
    placed = join_facts(docs, groups, ["lang", "source"], F.xxhash64("text")).select("lid", "gid", "text")
    kept, names = vocabulary(placed, least_docs, bits)
    of_group = kept.groupBy("gid").agg(F.sum("n").alias("total"))
    of_lang = kept.where("first").groupBy("lid").agg(F.count("*").alias("terms"), F.sum("ln").alias("lang_total"))
    stats = groups.join(of_group, "gid", "left").join(of_lang, "lid", "left").fillna(0, ["total", "terms", "lang_total"])
    stats = store(stats.withColumn("p0", share(F.lit(0), "total", "terms")), "audit-stats")

    known = join_facts(kept, stats.select("gid", "total", "terms", "lang_total", "p0"), ["gid"], F.col("digest"))
    rows = store(known.withColumns({"p": share("n", "total", "terms"), "q": share("ln", "lang_total", "terms")}).select("lid", "gid", "digest", "sub", "p", "q", "p0"), "audit-shares")
    names_of = stats.select("gid", "lang", "source")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    by_item = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")

    # All that tie with the last rank stay until their text is known.
    above = rows.where("p > q").select("lid", "gid", "digest", "sub", apart("p", "q").alias("value"))
    above = store(above.withColumn("r", F.rank().over(Window.partitionBy("gid").orderBy(F.col("value").desc()))).where(F.col("r") <= top).drop("r"), "audit-above")
    term = ["lid", "digest", "sub"]
    shown = store(above.select(*term).distinct(), "audit-shown")
    texts = store(join_facts(names, shown, term, F.col("term")), "audit-texts")
    listed = join_facts(above, texts, term, F.col("gid")).withColumnRenamed("term", "item")
    listed = listed.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    listed = join_facts(listed, names_of, ["gid"], F.col("item")).withColumn("part", F.lit("term")).select(*columns)

    sums = store(pair_sums(rows, stats), "audit-pairs")
    ways = F.explode(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("h")), F.struct(F.col("b").alias("gid"), F.col("a").alias("h"))))
    both = sums.select("value", ways.alias("w")).select("w.gid", "w.h", "value")
    both = join_facts(both, stats.select(F.col("gid").alias("h"), F.col("source").alias("item")), ["h"], F.col("gid"))
    both = both.withColumn("rank", F.row_number().over(by_item))
    both = join_facts(both, names_of, ["gid"], F.col("h")).withColumn("part", F.lit("pair")).select(*columns)
    return both.unionByName(listed)
