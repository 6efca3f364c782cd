"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share ``share`` times all words by weight; a source gives
at most ``max_repeat`` times its own words, and what is beyond is shared anew
by weight until no source is above.

Takes: a source's documents stand in the order of a hash of (doc_id, text).
Whole passes over the source come first; the rest of the target is one more
pass that stops where the running words reach it. The stopping hash is found
digit by digit (words per source and digit, then only the rows of the digit in
which the rest falls), so no source is sorted or gathered, however large.

Positions: each source has a schedule, its relative weight over training time
0 to 1, linear between knots. The schedule's integral, scaled to the target,
is the demand for the source's words up to a time; a document's place in the
running words of its source is inverted through it to a time. Documents are
then range-sorted by that time. The running words are exact: rows without texts
are range-sorted by source and hash once, and carry their sums.

Only DataFrame functions. How often a row is taken follows from its hash and
one row of plan per source; texts are shuffled to meet their places, and by the
final sort.

Defined results: null and empty texts have size 0 and take 0 words; a source
without words takes nothing; a null source is a source of its own, last in
order; rows equal in doc_id and text share a hash and so one fate, and stand at
one place of the curriculum; very long texts are counted whole, and a document
of any length moves only those behind it; an empty table gives an empty mix. Working
columns start with ``__mix``; a column ``mix`` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, store

WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at equally spaced knots of time, by the weight's place:
#: broad sources fade out, small ones come late.
SCHEDULES = ((3.0, 2.0, 1.0), (1.0, 2.0, 1.0), (1.0, 2.0, 3.0))
#: Bits of the hash settled per pass, and passes: 2^36 places to stop at.
_DIGIT, _PASSES = 12, 3
#: Plans of up to so many sources (about 100 bytes each) are broadcast; beyond, the
#: plan is joined with each source dealt over ``_SALTS`` tasks.
BROADCAST_SOURCES, _SALTS = 10_000, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def with_plan(rows: DataFrame, plan: DataFrame, salt: Column, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Each row with the struct ``__mix_plan`` of its source."""
    cols = F.struct(*[c for c in plan.columns if c != "source"]).alias("__mix_plan")
    plan = plan.select(F.col("source").alias("__mix_source"), cols)
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    if plan.limit(broadcast_sources + 1).count() <= broadcast_sources:
        return rows.join(F.broadcast(plan), same).drop("__mix_source")
    dealt = plan.withColumn("__mix_to", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = rows.withColumn("__mix_salt", F.pmod(salt, F.lit(_SALTS)).cast("int"))
    return salted.join(dealt, same & (F.col("__mix_salt") == F.col("__mix_to"))).drop("__mix_source", "__mix_salt", "__mix_to")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size) with place, weight and target.

    Where size / weight is small the cap is met first. Over sources in that
    order, the level is (total - caps before) / (weights not yet passed); the
    first source whose cap is not below its weight times the level settles it
    for all later ones, and each target is the lesser of cap and weight times
    the settled level.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    placed = running(store(sources, "mix-sources"), [F.col("source").asc_nulls_last()], index="place")
    placed = placed.withColumn("weight", F.element_at(w, (F.col("place") % len(weights) + 1).cast("int")))
    placed = store(placed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))), "mix-places")
    whole = placed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    by_cap = running(placed, [F.col("source_size") / F.col("weight"), F.col("place")], {"caps": "cap", "weights": "weight"}, index="nth")
    level = (F.lit(float(whole["size"] or 0) * share) - F.col("caps")) / (F.lit(float(whole["weight"] or 0)) - F.col("weights"))
    levels = store(by_cap.withColumn("level", level), "mix-levels")
    settled = levels.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct("nth", "level")).getField("level")).first()[0]
    target = F.col("cap") if settled is None else F.least("cap", F.lit(settled) * F.col("weight"))
    return levels.select("source", "source_size", "place", "weight", target.alias("target"))


def _stops(rows: DataFrame, goals: DataFrame, broadcast_sources: int) -> DataFrame:
    """Per source the ``_DIGIT * _PASSES`` leading hash bits, as a number, at
    which the last, partial pass stops: rows below it are taken once more.
    rows: source, size, h. goals: source, rest (words of the partial pass);
    a source that is whole without one stops at 0."""
    at = goals.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("head"))
    for k in range(_PASSES):
        held = with_plan(rows, at, F.col("h"), broadcast_sources).select("*", "__mix_plan.*")
        if k:
            held = held.where(F.shiftrightunsigned("h", 64 - _DIGIT * k) == F.col("head"))
        digit = F.shiftrightunsigned("h", 64 - _DIGIT * (k + 1)).bitwiseAND(F.lit((1 << _DIGIT) - 1))
        sums = held.groupBy("source", "rest", "head", digit.alias("digit")).agg(F.sum("size").alias("words"))
        # Running words in two levels, of 2^(_DIGIT / 2) rows a window.
        sums = store(sums.withColumn("high", F.shiftright("digit", _DIGIT // 2)), "mix-digits")
        before = Window.partitionBy("source").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
        highs = sums.groupBy("source", "high").agg(F.sum("words").alias("high_words"))
        lower = highs.select(F.col("source").alias("__s"), F.col("high").alias("__high"), F.coalesce(F.sum("high_words").over(before), F.lit(0)).alias("lower"))
        upto = F.sum("words").over(Window.partitionBy("source", "high").orderBy("digit"))
        run = sums.withColumn("upto", upto).join(lower, F.col("source").eqNullSafe(F.col("__s")) & (F.col("high") == F.col("__high")))
        # The first digit whose running words pass the rest; in the last pass,
        # the first that passes it by more than half its own words.
        half = F.col("words") / 2 if k == _PASSES - 1 else F.lit(0)
        passed = run.withColumn("upto", F.col("upto") + F.col("lower")).where(F.col("upto") - half > F.col("rest"))
        first = passed.groupBy("source").agg(F.min(F.struct("digit", "upto", "words")).alias("first"))
        joined = at.join(first.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
        # None passes it: the whole digit is taken, and the stop is behind it.
        at = store(
            joined.select(
                "source",
                F.when(F.col("first").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("first.upto") + F.col("first.words")).alias("rest"),
                ((F.col("head") + F.when(F.col("first").isNull(), 1).otherwise(0)) * (1 << _DIGIT) + F.coalesce("first.digit", F.lit(0))).alias("head"),
            ),
            "mix-stops",
        )
    return at.select("source", F.col("head").alias("stop"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): rows has doc_id, source, size and hash of each document
    and the words before it (``__mix_before``, in the order of source and
    hash); plan has one row per source: size, target, whole passes, the hash at
    which the partial pass stops, and the words before the source."""
    rows = store(docs.select("doc_id", "source", words(F.col("text")).alias("size"), place_hash().alias("h")), "mix-rows")
    order = [F.col("source").asc_nulls_last(), _unsigned("h"), F.col("doc_id"), F.col("size")]
    placed = running(rows, order, {"__mix_before": "size"}, index="__mix_nth").drop("__mix_nth")
    sources = store(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("__mix_before").alias("start")), "mix-sized")
    aims = targets(sources.select("source", "source_size"), weights, share, max_repeat)
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    aims = store(aims.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-aims")
    stops = _stops(rows, aims, broadcast_sources)
    plan = aims.drop("rest")
    for more in (stops, sources.drop("source_size")):
        more = more.withColumnRenamed("source", "__s")
        plan = plan.join(more, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return placed, store(plan.fillna(0, ["stop"]), "mix-plan")


def _unsigned(h: str) -> Column:
    """Orders a hash as the number that its bits spell, as stops are found."""
    return F.col(h).bitwiseXOR(F.lit(-(1 << 63)))


def _time_of(q: Column, knots: Sequence[float]) -> Column:
    """Time at which the share ``q`` of a schedule's integral is reached."""
    n = len(knots) - 1
    areas = [(a + b) / 2 / n for a, b in zip(knots, knots[1:], strict=False)]
    need = q * F.lit(sum(areas))
    out, done = F.lit(1.0), sum(areas)
    for i in reversed(range(n)):
        done -= areas[i]
        a, slope = knots[i], (knots[i + 1] - knots[i]) * n
        r = F.greatest(need - F.lit(max(done, 0.0)), F.lit(0.0))
        # a x + slope x^2 / 2 = r, solved without a difference of near numbers.
        x = F.coalesce(F.try_divide(2 * r, F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * r, F.lit(0.0)))), F.lit(0.0))
        t = F.least(F.lit(i / n) + x, F.lit((i + 1) / n))
        out = t if i == n - 1 else F.when(need < F.lit(done + areas[i]), t).otherwise(out)
    return out


def mixed(rows: DataFrame, plan: DataFrame, h: Column, schedules: Sequence[Sequence[float]] = SCHEDULES, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """``rows`` (with ``__mix_before``) with the struct ``mix``: source_size,
    target, copies and one time per copy."""
    r = with_plan(rows.drop("mix").withColumn("__mix_h", h), plan, h, broadcast_sources)
    p, hash_ = F.col("__mix_plan"), F.col("__mix_h")
    extra = F.when(F.shiftrightunsigned(hash_, 64 - _DIGIT * _PASSES) < p["stop"], 1).otherwise(0)
    r = r.select("*", (p["passes"] + extra).alias("__mix_copies"), (F.col("__mix_before") - p["start"]).alias("__mix_at"))
    kinds = len(schedules)

    def time(copy: Column) -> Column:
        q = F.coalesce(F.least(F.try_divide(F.col("__mix_at") + copy * p["source_size"], p["target"]), F.lit(1.0)), F.lit(0.0))
        out = _time_of(q, schedules[-1])
        for i in range(kinds - 1):
            out = F.when(p["place"] % kinds == i, _time_of(q, schedules[i])).otherwise(out)
        return out

    times = F.when(F.col("__mix_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("__mix_copies") - 1), time)).otherwise(F.array().cast("array<double>"))
    mix = F.struct(p["source_size"].alias("source_size"), p["target"].alias("target"), F.col("__mix_copies").alias("copies"), times.alias("times"))
    return r.withColumn("mix", mix).withColumn("__mix_order", hash_).drop("__mix_plan", "__mix_h", "__mix_copies", "__mix_at", "__mix_before")


def curriculum(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_repeat: float = 2.0, schedules: Sequence[Sequence[float]] = SCHEDULES, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The training mix: each document as often as it is taken, sorted by its
    training time; the columns of ``docs`` only."""
    rows, plan = plan_mix(docs, weights, share, max_repeat, broadcast_sources)
    # Equal rows have one place: each document meets one row, by its own hash.
    places = rows.groupBy("source", "h").agg(F.min("__mix_before").alias("__mix_before"))
    places = store(places.select(F.col("source").alias("__mix_from"), F.col("h").alias("__mix_key"), "__mix_before"), "mix-places")
    keyed = docs.withColumn("__mix_own", place_hash())
    keyed = keyed.join(places, (F.col("__mix_own") == F.col("__mix_key")) & F.col("source").eqNullSafe(F.col("__mix_from"))).drop("__mix_key", "__mix_from")
    m = mixed(keyed, plan, F.col("__mix_own"), schedules, broadcast_sources)
    order = ["__mix_time", "__mix_order"]
    copies = m.select(*docs.columns, "__mix_order", F.explode("mix.times").alias("__mix_time"))
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
