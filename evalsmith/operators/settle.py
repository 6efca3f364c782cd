"""Ordered decisions settled in parallel rounds.

A scan that decides one thing after another ("keep it unless an earlier kept
one forbids it") is a system of variables: each is true iff none of its
literals holds, and a literal is another variable or its negation. ``settle``
gives every variable its value without walking the scan.

A round looks at all variables at once. One without literals is true; one with
a literal and its negation, or with one that holds, is false; one with a single
literal stands for that literal's negation, and wherever it appears the literal
is put in its place (pointer doubling: a chain of n such variables is half as
long after each round). Values found are put in place the same way. A chain of
n takes about log2(n) rounds, however its case is sized. Variables that wait
for several others each may need as many rounds as the scan is deep, so rounds
are limited and what stays undecided is told.

Each round is a join and two aggregations over stored tables; a variable's
literals may spread over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store


def same_rows(keys: Sequence[str], left: str, right: str) -> Column:
    """Equality of the key columns of two aliased tables; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


#: Rounds that a chain of a million takes, and a few.
ROUNDS = 22


def settle(literals: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """(keys, v, value) of the variables, and (keys, v) of those undecided
    after ``rounds`` rounds, None if there are none.

    ``literals``: (keys, v, t, negated) says that v is false if t is true
    (false, where ``negated``). A variable without literals has a row with a
    null t. Every t must be a variable, and no variable may depend on itself.
    """
    keys = list(keys)
    # A literal and its negation are one row with both signs.
    distinct = lambda rows: rows.groupBy(*keys, "v", "t").agg(F.min("negated").alias("lo"), F.max("negated").alias("hi"), F.max("hit").alias("hit"))
    rows = store(distinct(literals.select(*keys, "v", "t", F.coalesce("negated", F.lit(False)).alias("negated"), F.lit(False).alias("hit"))), "settle-literals")
    found = []
    for _ in range(rounds):
        now = rows.groupBy(*keys, "v").agg(
            F.count("t").alias("n"), F.max("hit").alias("hit"), F.max(F.col("t").isNotNull() & (F.col("lo") != F.col("hi"))).alias("both"),
            F.max("t").alias("x"), F.max(F.when(F.col("t").isNotNull(), F.col("lo"))).alias("sign"),
        )
        value = F.when(F.col("hit") | F.col("both"), False).when(F.col("n") == 0, True)
        now = store(now.select(*keys, "v", "n", "x", "sign", value.alias("value")), "settle-now")
        decided = now.where("value IS NOT NULL").select(*keys, "v", "value")
        found.append(decided)
        left = now.where("value IS NULL")
        if left.isEmpty():
            left = None
            break
        mine = rows.alias("l").join(left.select(*keys, "v").alias("u"), same_rows(keys, "l", "u") & (F.col("l.v") == F.col("u.v")), "left_semi")
        signs = F.explode(F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))).alias("negated")
        mine = mine.select(*keys, "v", "t", signs)
        # A literal may have been put in place for one that names a variable
        # decided rounds ago: all values found are looked up.
        known = now.select(*keys, F.col("v").alias("of"), "x", "sign", "value", F.col("n").alias("many"))
        for old in found[:-1]:
            known = known.unionByName(old.withColumnRenamed("v", "of"), allowMissingColumns=True)
        joined = mine.alias("l").join(known.alias("k"), same_rows(keys, "l", "k") & (F.col("l.t") == F.col("k.of")), "left")
        # t alone stands for the negation of its one literal.
        single = F.col("value").isNull() & (F.col("many") == 1)
        t = F.when(F.col("value").isNotNull(), None).when(single, F.col("x")).otherwise(F.col("t"))
        negated = F.when(single, F.col("sign") == F.col("negated")).otherwise(F.col("negated"))
        hit = F.coalesce(F.col("value") != F.col("negated"), F.lit(False))
        rows = store(distinct(joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.v").alias("v"), t.alias("t"), negated.alias("negated"), hit.alias("hit"))), "settle-literals")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, left if left is None else left.select(*keys, "v")
