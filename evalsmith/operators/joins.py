"""Joins of a large table with a table of facts per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts of up to so many keys are broadcast (about 10 MB at 100 bytes a row).
BROADCAST_KEYS = 100_000
_SALTS = 32


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Inner or left join of ``rows`` with ``facts``, one row per ``keys``.

    The facts are counted: few enough are broadcast. Otherwise each is dealt
    over tasks by a salt that ``rows`` take from ``spread``, so that a key
    with a third of all rows is no single task."""
    keys = list(keys)
    if facts.limit(broadcast_keys + 1).count() <= broadcast_keys:
        return rows.join(F.broadcast(facts), keys, how)
    dealt = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).join(dealt, [*keys, "_salt"], how).drop("_salt")
