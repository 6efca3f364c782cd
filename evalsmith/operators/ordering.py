"""Global order, running sums and numbering without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store
from .joins import join_facts


def shuffle_partitions(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for ``rows`` small rows: the session's shuffle width, or more so
    that no task gets over about ``rows_per_task``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, index: str = "index", rows_per_task: int = 1_000_000) -> DataFrame:
    """``df`` with its 0-based ``index`` in the global ``order`` and, for each
    (name, column) of ``sums``, the sum over all rows before it.

    A range shuffle sorts the rows, the sorted rows are written once with their
    place, and one row per range carries the totals before it. No task sees
    more than its range, whatever keys repeat. ``df`` is read twice (ranges
    are sampled first): pass a stored table.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark, df.count(), rows_per_task)
    at = F.monotonically_increasing_id()
    rows = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at), "running")
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    sums = sums or {}
    ranges = rows.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{k}") for k, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # One row per range: ``parts`` rows, whatever the input.
    ranges = store(ranges.select("__range", totals("__n").alias("__n"), *[totals(f"__sum_{k}").alias(f"__sum_{k}") for k in sums]), "ranges")
    if sums:
        own = Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()})
    out = rows.join(F.broadcast(ranges), "__range").withColumn(index, F.col("__n") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    out = out.withColumns({k: F.col(k) + F.col(f"__sum_{k}") for k in sums})
    return out.drop("__at", "__range", "__n", *[f"__sum_{k}" for k in sums])


def numbered_within(df: DataFrame, groups: list[str], order: list[Column], out: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """``df`` with the 1-based place ``out`` of each row within its group in
    ``order``: the place in one global order by (group, order) less the
    group's first. A group of any size spreads over many ranges."""
    placed = store(running(store(df, "number-rows"), [*[F.col(g).asc_nulls_first() for g in groups], *order], index="__place", rows_per_task=rows_per_task), "number-placed")
    # One key for the join: structs with null fields are equal.
    placed = placed.withColumn("__group", F.struct(*groups))
    first = store(placed.groupBy("__group").agg(F.min("__place").alias("__first")), "number-firsts")
    joined = join_facts(placed, first, ["__group"], F.col("__place"))
    return joined.withColumn(out, F.col("__place") - F.col("__first") + 1).drop("__place", "__first", "__group")
