"""Subject-term categories.

Terms live in a long table ``(row key, pos, term)``. Frequencies, weights
and per-row winners are algebraic aggregations (count, sum, max_by over a
(weight, -first position) struct), so a hot term or a huge row is combined
map-side and never gathered into one list.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_of, py_strip
from ..session import store
from .joins import join_facts

# ---------------------------------------------------------------------------
# Broad subject categories by the first letter of a tree number.
BROAD_CATEGORIES = [
    ("A", "Anatomy"),
    ("B", "Organisms"),
    ("C", "Diseases"),
    ("D", "Chemicals and Drugs"),
    ("E", "Analytical, Diagnostic and Therapeutic Techniques and Equipment"),
    ("F", "Psychiatry and Psychology"),
    ("G", "Phenomena and Processes"),
    ("H", "Disciplines and Occupations"),
    ("I", "Anthropology, Education, Sociology, and Social Phenomena"),
    ("J", "Technology, Industry, and Agriculture"),
    ("K", "Humanities"),
    ("L", "Information Science"),
    ("M", "Persons"),
    ("N", "Health Care"),
    ("V", "Publication Characteristics"),
    ("Z", "Geographicals"),
]
UNKNOWN_CATEGORY = "Unknown Category"
UNKNOWN_WEIGHTED = "Unknown"
# ---------------------------------------------------------------------------


def category_of_letter(letter) -> Column:
    """Broad category name of a tree-number letter (one map lookup)."""
    m = F.create_map(*[F.lit(x) for kv in BROAD_CATEGORIES for x in kv])
    return F.coalesce(F.try_element_at(m, col_of(letter)), F.lit(UNKNOWN_CATEGORY))


def extract_mesh_terms(context) -> Column:
    """From a stringified context take ``'meshes': [...]`` and return the
    terms joined with ``; ``; null when there is no such list."""
    c = F.regexp_replace(col_of(context), "\n", " ")
    for s in ["array(", "dtype=object", ")"]:
        c = F.replace(c, F.lit(s), F.lit(""))
    c = py_strip(F.regexp_replace(c, r"\s+", " "))
    # One search: what precedes the list's end, or null without a list.
    found = F.regexp_substr(c, F.lit(r"'meshes':\s*\[[^\]]*\]"))
    body = F.regexp_replace(found, r"^'meshes':\s*\[|\]$", "")
    items = F.transform(F.split(body, "', '"), lambda x: F.regexp_replace(py_strip(x), "^'+|'+$", ""))
    return F.array_join(items, "; ")


def distinct_sorted_terms(meshes) -> Column:
    """O3: distinct terms, sorted, rejoined with ``; ``; blank input unchanged."""
    m = col_of(meshes)
    parts = F.transform(F.split(m, ";"), lambda x: py_strip(x))
    return F.when(F.coalesce(m, F.lit("")) == "", m).otherwise(F.array_join(F.array_sort(F.array_distinct(parts)), "; "))


def explode_terms(df: DataFrame, keys: Sequence[str], meshes: str, sep: str = ";") -> DataFrame:
    """One row per term (split on ``sep``, trimmed), position kept."""
    return df.select(*keys, F.posexplode(F.split(F.col(meshes), sep)).alias("pos", "term")).withColumn(
        "term", py_strip(F.col("term"))
    )


def descriptor_categories(descriptors: DataFrame, name: str = "name", tree_numbers: str = "tree_numbers", order: str = "file_pos") -> DataFrame:
    """A9 + J2's dedup: per descriptor name (first in file order wins), the
    most common first letter of its tree numbers (ties: first met), mapped to
    a broad category; no tree numbers -> Unknown Category."""
    first = descriptors.groupBy(name).agg(F.min_by(F.col(tree_numbers), F.col(order)).alias("_tn"))
    # the letter is staged as a column so the array scan runs once per name
    letters = first.select(name, most_common_letter(F.col("_tn")).alias("_letter"))
    return letters.select(
        name, F.when(F.col("_letter").isNull(), F.lit(UNKNOWN_CATEGORY)).otherwise(category_of_letter("_letter")).alias("category")
    )


def most_common_letter(tree_numbers) -> Column:
    """A9 on one descriptor's tree-number list (bounded by the record): the
    most common first letter, ties to the one met first; null if none."""
    letters = F.filter(
        F.transform(F.coalesce(col_of(tree_numbers), F.array()), lambda t: F.substring(t, 1, 1)), lambda l: l != ""
    )
    scored = F.transform(
        F.array_distinct(letters),
        lambda l: F.struct(
            F.size(F.filter(letters, lambda x: x == l)).alias("n"), (-F.array_position(letters, l)).alias("fp"), l.alias("l")
        ),
    )
    return F.array_max(scored)["l"]


def category_of_tree_numbers(tree_numbers) -> Column:
    letter = most_common_letter(tree_numbers)
    return F.when(letter.isNull(), F.lit(UNKNOWN_CATEGORY)).otherwise(category_of_letter(letter))


def lookup_category(terms: DataFrame, categories: DataFrame, term: str = "term", name: str = "name") -> DataFrame:
    """Exact-name lookup; a miss gives Unknown Category. An equi-join:
    Spark broadcasts the category side when its statistics show it is small
    and shuffles both sides otherwise."""
    c = categories.select(F.col(name).alias(term), F.col("category"))
    return terms.join(c, term, "left").withColumn("category", F.coalesce(F.col("category"), F.lit(UNKNOWN_CATEGORY)))


def term_weight_category(terms: DataFrame, weights: DataFrame, categories: DataFrame, spread: str, term: str = "term", name: str = "name") -> DataFrame:
    """Each term row with its weight and category; a term that the tables
    lack weighs 0 and is of Unknown Category. The two tables are brought
    together first, so the rows are joined once, and frequent terms are dealt
    over tasks by ``spread`` where the tables are too large to broadcast."""
    known = weights.select(term, "weight").join(categories.select(F.col(name).alias(term), "category"), term, "full")
    out = join_facts(terms, known, [term], F.col(spread), how="left")
    return out.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "category": F.coalesce("category", F.lit(UNKNOWN_CATEGORY))})


def term_frequency(terms: DataFrame, term: str = "term") -> DataFrame:
    """A5 + A6: rows containing each term (terms are distinct per row) and
    the inverse-frequency weight 1 / frequency."""
    return terms.groupBy(term).agg(F.count("*").alias("frequency")).withColumn("weight", 1.0 / F.col("frequency"))


def term_category_map(rows: DataFrame, row_no: str = "row_no", meshes: str = "meshes", categories: str = "categories") -> DataFrame:
    """A10: term -> category from (terms, categories) rows paired by position,
    cut to the shorter list; the last row (then last position) wins.

    Where ``row_no`` is a whole number, a term's last place is one number and
    its category is told by its hash: both fit a hash aggregation, which takes
    repeats in before anything is sorted or spilled. The distinct categories
    are looked up by hash afterwards."""
    terms = F.split(F.col(meshes), "; ")
    n = F.least(F.size(terms), F.size(F.col(categories)))
    z = F.arrays_zip(F.slice(terms, 1, n).alias("t"), F.slice(F.col(categories), 1, n).alias("c"))
    term = py_strip(F.col("tc.t")).alias("term")
    if isinstance(rows.schema[row_no].dataType, T.IntegralType):
        names = rows.select(F.explode(F.array_distinct(F.col(categories))).alias("_c")).where("_c IS NOT NULL").distinct()
        names = store(names.select(F.xxhash64("_c").alias("_code"), py_strip("_c").alias("category")), "category-names")
        if names.groupBy("_code").count().where("count > 1").isEmpty():
            # A row without a number comes before all others.
            number = F.coalesce(F.col(row_no).cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
            ex = rows.select((number * F.lit(Decimal(1 << 31))).alias("_row"), F.posexplode(z).alias("pos", "tc"))
            code = F.when(F.col("tc.c").isNotNull(), F.xxhash64("tc.c"))
            last = ex.groupBy(term).agg(F.max_by(code, F.col("_row") + F.col("pos")).alias("_code"))
            return join_facts(last, names, ["_code"], F.col("term"), how="left").select("term", "category")
    ex = rows.select(row_no, F.posexplode(z).alias("pos", "tc"))
    return ex.groupBy(term).agg(F.max_by(py_strip(F.col("tc.c")), F.struct(F.col(row_no), F.col("pos"))).alias("category"))


def category_by_weight(weighted: DataFrame, keys: Sequence[str], category: str = "category", weight: str = "weight", pos: str = "pos") -> DataFrame:
    """Per row, the category with the largest summed term weight; ties go
    to the category met first; sums are rounded to 12 decimals (Q18)."""
    keys = list(keys)
    per = weighted.groupBy(*keys, category).agg(F.round(F.sum(weight), 12).alias("_w"), F.min(pos).alias("_fp"))
    return per.groupBy(*keys).agg(F.max_by(F.col(category), F.struct(F.col("_w"), -F.col("_fp"))).alias("weighted_category"))


def category_by_count(cats: DataFrame, keys: Sequence[str], category: str = "category", pos: str = "pos") -> DataFrame:
    """Most frequent category (ties: first met); when that is Unknown
    Category and another exists, the runner-up."""
    keys = list(keys)
    per = cats.groupBy(*keys, category).agg(F.count("*").alias("_n"), F.min(pos).alias("_fp"))
    is_unknown = F.col(category) == UNKNOWN_CATEGORY
    top = per.groupBy(*keys).agg(
        F.max_by(F.col(category), F.struct(F.col("_n"), -F.col("_fp"))).alias("_top"),
        F.max_by(F.col(category), F.when(~is_unknown, F.struct(F.col("_n"), -F.col("_fp")))).alias("_known"),
    )
    return top.select(
        *keys,
        F.when((F.col("_top") == UNKNOWN_CATEGORY) & F.col("_known").isNotNull(), F.col("_known"))
        .otherwise(F.col("_top"))
        .alias("frequent_category"),
    )


def category_winners(rows: DataFrame, keys: Sequence[str], category: str = "category", weight: str = "weight", pos: str = "pos") -> DataFrame:
    """A7 + A8 + term count from one (row, category) aggregation and one
    per-row aggregation (both algebraic): the fused form of
    ``category_by_weight`` and ``category_by_count``."""
    keys = list(keys)
    per = rows.groupBy(*keys, category).agg(
        F.round(F.sum(weight), 12).alias("_w"), F.count("*").alias("_n"), F.min(pos).alias("_fp")
    )
    known = F.col(category) != UNKNOWN_CATEGORY
    top = per.groupBy(*keys).agg(
        F.max_by(F.col(category), F.struct(F.col("_w"), -F.col("_fp"))).alias("weighted_category"),
        F.max_by(F.col(category), F.struct(F.col("_n"), -F.col("_fp"))).alias("_top"),
        F.max_by(F.col(category), F.when(known, F.struct(F.col("_n"), -F.col("_fp")))).alias("_known"),
        F.sum("_n").alias("n_terms"),
    )
    return top.select(
        *keys,
        "n_terms",
        "weighted_category",
        F.when((F.col("_top") == UNKNOWN_CATEGORY) & F.col("_known").isNotNull(), F.col("_known"))
        .otherwise(F.col("_top"))
        .alias("frequent_category"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distribution of a column, most frequent first."""
    return df.groupBy(col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col(col))
