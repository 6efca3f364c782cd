"""Generate-judge-revise bookkeeping.

Attempts live in a long table ``(item_id, attempt_no, ...)``; every step is
a per-item window or aggregation, so items are processed in parallel and an
item's attempts are combined with algebraic aggregates (min_by / max_by),
never collected into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_of


def draw_shown_answer(item_id, seed: int) -> Column:
    """1 = show the hallucinated answer, 0 = the true one.

    Deterministic: parity of the last hex digit of md5('item_id:seed'), so
    both QA runs (with / without knowledge) judge the same draw (Q2) and
    any engine with md5 can reproduce it.
    """
    key = F.concat_ws(":", col_of(item_id).cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key), 32, 1), 16, 10).cast("int") % 2).cast("int")


def difficulty_from_votes(votes) -> Column:
    """All judges fooled -> hard; more than one -> medium; else easy.

    ``votes`` is an array<boolean>; an empty list counts as all fooled
    (hard), as in the reference.
    """
    v = col_of(votes)
    n_fooled = F.size(F.filter(v, lambda x: F.coalesce(x, F.lit(False))))
    return F.when(n_fooled == F.size(v), "hard").when(n_fooled > 1, "medium").otherwise("easy")


def any_fooled(votes) -> Column:
    """At least one judge fooled."""
    return F.exists(col_of(votes), lambda x: F.coalesce(x, F.lit(False)))


def first_success(attempts: DataFrame, item: str = "item_id", order: str = "attempt_no", success: str = "any_fooled") -> DataFrame:
    """Keep attempts up to and including the first that fooled a judge
    (all attempts of an item that never succeeded)."""
    w = Window.partitionBy(item)
    first_ok = F.min(F.when(F.col(success), F.col(order))).over(w)
    return attempts.withColumn("_first_ok", first_ok).filter(
        F.col("_first_ok").isNull() | (F.col(order) <= F.col("_first_ok"))
    ).drop("_first_ok")


def final_answer(
    attempts: DataFrame,
    item: str = "item_id",
    order: str = "attempt_no",
    success: str = "any_fooled",
    answer: str = "answer",
    similarity: str = "similarity",
    difficulty: str = "difficulty",
) -> DataFrame:
    """T4: the first successful answer, else the answer MOST similar to the
    truth (ties: earliest attempt). Algebraic aggregates per item (Q12)."""
    ok = F.col(success)
    has_answer = F.coalesce(F.col(answer), F.lit("")) != ""
    first_ok = F.min_by(F.struct(F.col(answer), F.col(difficulty), F.col(order)), F.when(ok, F.col(order)))
    best = F.max_by(
        F.struct(F.col(answer), F.col(difficulty), F.col(order)),
        F.when(has_answer, F.struct(F.col(similarity), -F.col(order))),
    )
    g = attempts.groupBy(item).agg(
        F.max(ok.cast("int")).alias("_ok"),
        first_ok.alias("_first"),
        best.alias("_best"),
        F.count("*").alias("attempts"),
    )
    pick = F.when(F.col("_ok") == 1, F.col("_first")).otherwise(F.col("_best"))
    return g.select(
        item,
        pick[answer].alias("least_similar_answer"),
        pick[difficulty].alias("final_difficulty_level"),
        pick[order].alias("chosen_attempt"),
        (F.col("_ok") == 1).alias("succeeded"),
        "attempts",
    )


def pending(inputs: DataFrame, done: DataFrame, key) -> DataFrame:
    """Items not yet done (left anti join on the key)."""
    keys = [key] if isinstance(key, str) else list(key)
    # an anti join already ignores repeated keys: no distinct (and no extra shuffle)
    return inputs.join(done.select(*keys), keys, "left_anti")


def widen_attempts(
    attempts: DataFrame,
    n_generations: int,
    n_judges: int,
    item: str = "item_id",
) -> DataFrame:
    """Long attempts to the published wide schema.

    ``attempts`` holds (item, attempt_no 1..n, answer, justification,
    difficulty, votes array<struct<fooled, reasoning>>). One grouped
    aggregation with a fixed column set (the widths are parameters, so the
    schema is known before the job runs).
    """
    cols = []
    for i in range(1, n_generations + 1):
        at = F.col("attempt_no") == i
        cols.append(F.max_by(F.col("answer"), F.when(at, F.lit(1))).alias(f"hallucinated_answer_{i}"))
        cols.append(F.max_by(F.col("justification"), F.when(at, F.lit(1))).alias(f"justification_{i}"))
        for j in range(1, n_judges + 1):
            v = F.try_element_at(F.col("votes"), F.lit(j))
            cols.append(F.max_by(v["fooled"], F.when(at, F.lit(1))).alias(f"fooled_discriminator_{j}_{i}"))
            cols.append(F.max_by(v["reasoning"], F.when(at, F.lit(1))).alias(f"discriminator_reasoning_{j}_{i}"))
        cols.append(F.max_by(F.col("difficulty"), F.when(at, F.lit(1))).alias(f"difficulty_level_{i}"))
    return attempts.groupBy(item).agg(*cols)
