"""Shared helpers for the query bindings on the driver tables.

The reference's own inputs (model replies, guideline records) are not
public, so each binding derives its input from the driver tables with
expressions that Spark and DuckDB compute identically: ``md5`` hex digits
stand in for model replies and random draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col_of

# Fixed judge names used by the bindings.
JUDGES = ["judge_a", "judge_b"]


def key_text(*parts) -> Column:
    """``a:b:c`` text key of columns / literals (null parts become empty)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def hex_digit(key: Column, pos: int) -> Column:
    """Value 0-15 of the ``pos``-th (1-based) hex digit of md5(key)."""
    return F.conv(F.substring(F.md5(key), pos, 1), 16, 10).cast("int")


def pick(options: list[str], idx: Column) -> Column:
    """``options[idx]`` for a 0-based index column."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx + 1)


def sql_list(options: list[str]) -> str:
    """The same list as a DuckDB list literal."""
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def sql_hex_digit(key_sql: str, pos: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5({key_sql}), {pos}, 1)) - 1)"


def explode_judges(df, judges=None, name: str = "model_name"):
    """One row per (input row, judge) via a generator, not a join."""
    js = judges or JUDGES
    return df.withColumn(name, F.explode(F.array(*[F.lit(j) for j in js])))


def difficulty_from_size(n_chars) -> Column:
    n = col_of(n_chars)
    return F.when(n < 500, "easy").when(n < 2000, "medium").otherwise("hard")


SQL_DIFFICULTY = "CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium' ELSE 'hard' END"
