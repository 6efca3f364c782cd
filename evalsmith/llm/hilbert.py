"""Sharding along a Hilbert curve over document metadata.

Several metadata columns are quantised to ``bits`` bits each, so that a step
holds about as many rows as the next; texts are quantised as whole values in
the order of their UTF-8 bytes, whatever their script or common beginnings, and
sizes by their logarithm. The quantised values are a point in a
cube; its index on the Hilbert curve orders the rows, and equal runs of that
order become shards. Neighbours on the curve are near in every dimension, so
a shard's files have narrow value ranges and a filter on any of the columns
prunes most of them.

Only DataFrame functions. The law is ``rows``: shard sizes differ by one row
at most. Equal points are ordered by text checksum, hash and id.

Defined results: null values lie below all others of their dimension; a null
text has size ``overhead``; repeated rows stand side by side; fewer rows than
shards leave shards empty; an empty table gives none. Only the columns named
by the dimensions, doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import BROADCAST_KEYS, join_facts
from .common import running, store

#: Codes are so many bits wide before they are ranked.
_CODE_BITS = 16


def _curve_tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """For each step w along an n-cube's Gray path: the corner where the
    sub-cube is entered, the axis along which it is crossed; and the step at
    each corner."""
    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: ((~i & (i + 1)).bit_length() - 1) if i >= 0 else 0  # noqa: E731  ones at the low end
    enter = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    cross = [0 if w == 0 else (trailing(w - 1) if w % 2 == 0 else trailing(w)) % n for w in range(1 << n)]
    step = [0] * (1 << n)
    for w in range(1 << n):
        step[gray(w)] = w
    return enter, cross, step


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point with ``bits`` bits per axis.

    Bit by bit from the top: the corner of the sub-cube that holds the point,
    seen in the current orientation (entry corner e, axis d), is a step along
    the Gray path, and that step turns the orientation for the next bit.
    """
    n = len(dims)
    enter, cross, step = (F.array(*[F.lit(x) for x in t]) for t in _curve_tables(n))
    mask = (1 << n) - 1

    def left(x: Column, by: Column) -> Column:
        return F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - by)).bitwiseAND(F.lit(mask))

    def right(x: Column, by: Column) -> Column:
        return left(x, (F.lit(n) - by) % n)

    def one(state: Column, i: Column) -> Column:
        corner = F.lit(0)
        for k, x in enumerate(dims):
            corner = corner.bitwiseOR(F.shiftleft(F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)), k))
        turn = (state["d"] + 1) % n
        w = F.element_at(step, right(corner.bitwiseXOR(state["e"]), turn) + 1)
        return F.struct(
            F.shiftleft(state["h"], n).bitwiseOR(w.cast("long")).alias("h"),
            state["e"].bitwiseXOR(left(F.element_at(enter, w + 1), turn)).alias("e"),
            ((state["d"] + F.element_at(cross, w + 1) + 1) % n).alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, one)["h"]


def text_steps(rows: DataFrame, cols: dict[str, str], bits: int, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``rows`` with, for each (column, out) of ``cols``, the step ``out``, of
    2^bits, in which the middle of the rows of its whole value lies, null
    before all others. One row per distinct value is ordered, by ranges; few
    are broadcast, more joined with each dealt over tasks."""
    value = lambda c: F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), value(c).alias("__value")) for i, c in enumerate(cols)]))
    counts = store(rows.select(pairs.alias("p")).groupBy("p.dim", "p.__value").agg(F.count("*").alias("n")), "hilbert-values")
    total = counts.where("dim = 0").agg(F.sum("n")).first()[0] or 1
    # Every row has one value in each dimension: ``total`` rows a dimension.
    placed = running(counts, [F.col("dim"), F.col("__value")], {"before": "n"})
    step = F.floor((F.col("before") - F.col("dim") * F.lit(total) + F.col("n") / 2) * (1 << bits) / F.lit(total)).cast("int")
    steps = store(placed.select("dim", "__value", step.alias("step")), "hilbert-text-steps")
    for i, (c, out) in enumerate(cols.items()):
        own = steps.where(F.col("dim") == i).select("__value", F.col("step").alias(out))
        rows = join_facts(rows.withColumn("__value", value(c)), own, ["__value"], F.struct("doc_id", "text_crc32"), broadcast_keys=broadcast_keys).drop("__value")
    return rows


def number_code(col: Column) -> Column:
    """Order-keeping code of a number from 0: its logarithm in 1024 steps per
    doubling; 0 for null."""
    return F.when(col.isNull(), 0).otherwise(F.least(F.floor(F.log2(F.greatest(col, F.lit(0)) + 1) * 1024) + 1, F.lit((1 << _CODE_BITS) - 1))).cast("int")


def quantised(rows: DataFrame, codes: list[str], bits: int) -> DataFrame:
    """``rows`` with each code replaced by the step, of 2^bits, in which the
    middle of its rows lies. The counts by (dimension, code) have at most
    2^_CODE_BITS rows per dimension, whatever the input, and so may be
    broadcast."""
    n = len(codes)
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(c).alias("code")) for i, c in enumerate(codes)]))
    counts = rows.select(pairs.alias("p")).groupBy("p.dim", "p.code").agg(F.count("*").alias("n"))
    counts = store(counts.withColumn("high", F.shiftright("code", _CODE_BITS // 2)), "hilbert-counts")
    # Running counts in two levels of at most 2^(_CODE_BITS / 2) rows a window.
    before = Window.partitionBy("dim").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    highs = counts.groupBy("dim", "high").agg(F.sum("n").alias("high_n"))
    highs = highs.select("dim", "high", F.coalesce(F.sum("high_n").over(before), F.lit(0)).alias("lower"), F.sum("high_n").over(Window.partitionBy("dim")).alias("total"))
    upto = F.col("lower") + F.sum("n").over(Window.partitionBy("dim", "high").orderBy("code"))
    counts = counts.join(F.broadcast(highs), ["dim", "high"])
    step = F.floor((upto - F.col("n") / 2) * (1 << bits) / F.col("total")).cast("int")
    steps = store(counts.select("dim", "code", step.alias("step")), "hilbert-steps")
    for i in range(n):
        own = steps.where(F.col("dim") == i).select(F.col("code").alias(codes[i]), F.col("step").alias(f"__step_{i}"))
        rows = rows.join(F.broadcast(own), codes[i]).withColumn(codes[i], F.col(f"__step_{i}")).drop(f"__step_{i}")
    return rows


def shard_by_curve(docs: DataFrame, shards: int = 40, bits: int = 7, text_dims: tuple[str, ...] = ("lang", "source"), overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, the text dimensions,
    curve index, shard and slot. The dimensions are ``text_dims`` and the size.

    Texts are read once and stay where they are; only metadata is shuffled.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + overhead
    # Renamed at once, so that no dimension clashes with the result.
    named = {f"dim_{c}": F.col(c).cast("string") for c in text_dims}
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *[v.alias(k) for k, v in named.items()])
    rows = store(rows, "hilbert-rows")
    codes = [*[f"code_{k}" for k in named], "code_size"]
    points = quantised(rows.withColumn("code_size", number_code(F.col("size"))), ["code_size"], bits)
    if named:
        points = text_steps(points, {k: f"code_{k}" for k in named}, bits)
    curve = hilbert_index([F.col(c) for c in codes], bits)
    points = store(points.withColumn("curve_index", curve).withColumn("tie", F.xxhash64("doc_id", "text_crc32")).drop(*codes), "hilbert-points")
    n = points.count()
    order = [F.col(c) for c in ("curve_index", "text_crc32", "tie", "doc_id")]
    ranked = running(points, order, index="__rank")
    shard = F.expr(f"__rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(__shard * {n} + {shards} - 1) div {shards}")
    return ranked.withColumn("__shard", shard).select(
        "doc_id", "size", "text_crc32", *named, "curve_index", F.col("__shard").cast("int").alias("shard"), (F.col("__rank") - first).alias("slot")
    )
