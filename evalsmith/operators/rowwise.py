"""Cases compared inside their own rows.

A case usually comes as one row with its lists, and a short list is compared,
matched or de-duplicated where it lies: no token row, no pair and no text is
shuffled. ``split_cases`` tells which rows that holds for. A longer case, or one
whose rows share their keys with others (or have none), is the ``rest``: it goes
the way of ``matching``, which spreads a case over tasks by its tokens. Both
give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import first_distinct_items
from ..functions.similarity import similarity_label
from ..functions.text import norm_text
from .joins import join_facts
from .matching import match_columns, token_pair_scores

#: Items a list may have, and characters a case, to be compared in its row
#: (65,536 pairs at most); longer ones are spread over tasks.
ROW_ITEMS = 256
ROW_CHARS = 1 << 20


def fits_row(*lists: str) -> Column:
    """Whether all lists of a case are short enough."""
    out = F.lit(True)
    for c in lists:
        items = F.coalesce(F.col(c), F.array())
        out = out & (F.size(items) <= ROW_ITEMS) & (F.length(F.array_join(items, "")) <= ROW_CHARS)
    return out


def split_cases(cases: DataFrame, keys: Sequence[str], fits: Column) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``cases`` that are a whole case and fit, and the rest (None
    if there is none). ``cases`` is read several times."""
    keys = list(keys)
    whole = fits
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    twice = cases.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1")
    flagged = cases.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    if not twice.isEmpty():
        flagged = join_facts(flagged, twice, keys, F.monotonically_increasing_id(), how="left")
        flagged = flagged.withColumn("_whole", F.col("_whole") & F.col("_rows").isNull()).drop("_rows")
    rest = flagged.where(~F.col("_whole")).drop("_whole")
    return flagged.where("_whole").drop("_whole"), None if rest.isEmpty() else rest


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _token_sets(items: Column) -> Column:
    """``tokens`` of each item of a list."""
    normal = F.transform(F.coalesce(items, F.array()), lambda x: norm_text(F.coalesce(x, F.lit(""))))
    return F.transform(normal, lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " "))))


def _all_pairs(left: Column, right: Column, pair: Callable[[Column, Column, Column, Column], Column], keep: Callable[[Column], Column]) -> Column:
    """``pair`` of every element of two lists (with their places), where ``keep`` holds."""
    return F.flatten(F.transform(left, lambda x, i: F.filter(F.transform(right, lambda y, j: pair(x, i, y, j)), keep)))


def _shared(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y))


def row_candidates(cases: DataFrame, keys: Sequence[str], left: str, right: str, tau: float, mode: str = "min") -> DataFrame:
    """``overlap_candidates`` of cases that fit their rows, with the token sets:
    (keys, a, b, tok_a, tok_b)."""
    if not 0 < tau <= 1:
        raise ValueError("tau must be in (0, 1]")
    of = {"min": F.least, "max": F.greatest}[mode]
    pair = lambda x, i, y, j: F.struct(i.alias("a"), j.alias("b"), x.alias("tok_a"), y.alias("tok_b"), _shared(x, y).alias("n"))
    keep = lambda p: (p["n"] > 0) & (p["n"] >= of(F.size(p["tok_a"]), F.size(p["tok_b"])) * F.lit(tau) - F.lit(1e-9))
    both = F.struct(_token_sets(F.col(left)).alias("l"), _token_sets(F.col(right)).alias("r"))
    pairs = _bound(both, lambda s: _all_pairs(s["l"], s["r"], pair, keep))
    return cases.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.a", "_p.b", "_p.tok_a", "_p.tok_b")


def row_case_pairs(cases: DataFrame, keys: Sequence[str], left: str, right: str, threshold: float) -> DataFrame:
    """``case_pairs`` of cases that fit their rows."""
    keys = list(keys)

    def classes(sets: Column) -> Column:
        one = lambda s: F.transform(F.array_distinct(s), lambda t: F.struct(
            t.alias("tok"), (F.array_position(s, t) - 1).cast("int").alias("idx"), F.size(F.filter(s, lambda x: x == t)).cast("long").alias("n")
        ))
        return _bound(F.transform(sets, lambda t: F.array_sort(t)), one)

    def pair(x, i, y, j):
        return F.struct(x["idx"].alias("g"), y["idx"].alias("r"), (x["n"] * y["n"]).alias("n_pairs"), x["tok"].alias("tok_a"), y["tok"].alias("tok_b"))

    both = F.struct(classes(_token_sets(F.col(left))).alias("l"), classes(_token_sets(F.col(right))).alias("r"))
    linked = _bound(both, lambda s: _all_pairs(s["l"], s["r"], pair, lambda p: F.arrays_overlap(p["tok_a"], p["tok_b"])))
    size = lambda c: F.size(F.coalesce(F.col(c), F.array())).cast("long")
    none = F.array().cast("array<string>")

    def with_others(listed: Column) -> Column:
        others = size(left) * size(right) - F.aggregate(listed, F.lit(0).cast("long"), lambda a, p: a + p["n_pairs"])
        row = F.struct(F.lit(None).cast("int").alias("g"), F.lit(None).cast("int").alias("r"), others.alias("n_pairs"), none.alias("tok_a"), none.alias("tok_b"))
        return F.concat(listed, F.filter(F.array(row), lambda p: p["n_pairs"] > 0))

    rows = cases.select(*keys, F.explode(_bound(linked, with_others)).alias("_p")).select(*keys, "_p.*")
    return token_pair_scores(rows).drop("overlap").withColumn("label", similarity_label("score", threshold))


def row_matches(cases: DataFrame, threshold: float, generated: str = "generated_actions", reference: str = "reference_actions") -> DataFrame:
    """``greedy_pairs`` by the two-way token score and ``match_metrics`` of
    cases that fit their rows: the edges of a case in order, each taken if both
    its ends are free."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")

    def edge(x, i, y, j):
        n = _shared(x, y)
        return _bound(n, lambda n: F.struct(i.alias("g"), j.alias("r"), F.when(n > 0, F.least(n / F.size(x), n / F.size(y))).otherwise(0.0).alias("score")))

    both = F.struct(_token_sets(F.col(generated)).alias("l"), _token_sets(F.col(reference)).alias("r"))
    edges = _bound(both, lambda s: _all_pairs(s["l"], s["r"], edge, lambda e: e["score"] >= threshold))
    ordered = F.array_sort(F.transform(edges, lambda e: F.struct((-e["score"]).alias("s"), e["g"].alias("g"), e["r"].alias("r"), e["score"].alias("score"))))
    taken = F.aggregate(
        ordered, F.array().cast("array<struct<s:double,g:int,r:int,score:double>>"),
        lambda acc, e: F.when(F.exists(acc, lambda t: (t["g"] == e["g"]) | (t["r"] == e["r"])), acc).otherwise(F.concat(acc, F.array(e))),
    )
    c = cases.withColumn("_pairs", taken)
    c = c.withColumns({"_m": F.size("_pairs").cast("long"), "_s": F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p["score"])})
    return match_columns(c, generated, reference)


def row_semantic_dedup(rows: DataFrame, keys: Sequence[str], texts: str, threshold: float) -> DataFrame:
    """W6 and ``semantic_dedup`` (token scorer) of cases that fit their rows,
    ``texts`` being the list: (keys, idx, text, status). The scan itself: an
    item is kept unless it is redundant to one kept before it."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")

    def redundant(x, y):
        # min(fwd, bwd) is n / larger set; overlap and max(fwd, bwd) are n / smaller.
        larger, smaller = F.greatest(F.size(x), F.size(y)), F.least(F.size(x), F.size(y))
        return _bound(_shared(x, y), lambda n: (n / larger >= threshold) | (n / smaller >= max(0.5, threshold)))

    def scan(s):
        kept = F.aggregate(
            s["t"], F.array().cast("array<struct<i:int,tok:array<string>>>"),
            lambda acc, x: F.when(F.exists(acc, lambda k: redundant(k["tok"], x["tok"])), acc).otherwise(F.concat(acc, F.array(x))),
        )
        places = F.transform(kept, lambda k: k["i"])
        return _bound(places, lambda p: F.transform(s["items"], lambda e: F.struct(
            e["i"].alias("idx"), e["v"].alias("text"), F.when(F.array_contains(p, e["i"]), "kept").otherwise("removed").alias("status")
        )))

    def with_sets(items):
        sets = _token_sets(F.transform(items, lambda e: e["v"]))
        return F.struct(items.alias("items"), F.zip_with(items, sets, lambda e, t: F.struct(e["i"].alias("i"), t.alias("tok"))).alias("t"))

    out = _bound(_bound(first_distinct_items(F.col(texts)), with_sets), scan)
    return rows.select(*keys, F.explode(out).alias("_o")).select(*keys, "_o.*")
