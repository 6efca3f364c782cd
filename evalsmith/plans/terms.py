"""Subject-term category bindings on ``documents``.

Terms are the distinct lower-case words, in any script, of each whole document (sorted);
the descriptor table is derived from the vocabulary: a term's tree numbers
are its letters, so its broad category is that of its most common letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_facts
from ..operators.terms import (
    BROAD_CATEGORIES,
    UNKNOWN_CATEGORY,
    UNKNOWN_WEIGHTED,
    category_winners,
    descriptor_categories,
    lookup_category,
    term_frequency,
    term_weight_category,
    value_counts,
)
from ..session import store, table


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(table(spark, sf_dir, "documents"))


def _terms(d: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(\p{L}+)"), 1)
    terms = F.array_sort(F.array_distinct(words))
    return d.select("doc_id", F.posexplode(terms).alias("pos", "term"))


def vocabulary_descriptors(terms: DataFrame) -> DataFrame:
    vocab = terms.select("term").distinct()
    tn = F.transform(
        F.sequence(F.lit(1), F.length("term")),
        lambda i: F.concat(F.upper(F.substring(F.col("term"), i, 1)), F.format_string("%03d", i)),
    )
    return vocab.select(F.col("term").alias("name"), tn.alias("tree_numbers"), F.lit(0).alias("file_pos"))


def term_category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, term, weight, category): the per-term facts (frequency,
    weight, descriptor category) are gathered in one term-keyed table first,
    so the large (doc, term) table is joined once, with frequent terms dealt
    over tasks where the vocabulary is too large to broadcast."""
    # the (doc, term) table feeds the vocabulary and the join: extract once
    terms = store(doc_terms(spark, sf_dir), "doc-terms")
    freq = term_frequency(terms)  # A5 + A6, one algebraic aggregation
    cats = descriptor_categories(vocabulary_descriptors(freq.select("term")))  # A9, per term
    info = lookup_category(freq.select("term", "weight"), cats)  # J2 on the vocabulary
    return join_facts(terms, info, ["term"], F.col("doc_id"))


def term_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = category_winners(term_category_rows(spark, sf_dir), ["doc_id"])  # A7 + A8
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return (
        docs.join(winners, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce(F.col("n_terms"), F.lit(0)).alias("n_terms"),
            F.coalesce(F.col("weighted_category"), F.lit(UNKNOWN_WEIGHTED)).alias("weighted_category"),
            F.coalesce(F.col("frequent_category"), F.lit(UNKNOWN_CATEGORY)).alias("frequent_category"),
        )
    )


def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(term_categories(spark, sf_dir), "weighted_category")


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document terms against weights and categories of the benchmark's
    vocabulary; terms outside it get the defaults."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    vocabulary = term_frequency(_terms(b))
    cats = descriptor_categories(vocabulary_descriptors(vocabulary.select("term")))
    return term_weight_category(doc_terms(spark, sf_dir), vocabulary, cats, "doc_id").select("doc_id", "pos", "term", "weight", "category")


QUERIES = {"term_categories": term_categories, "category_distribution": category_distribution, "term_weights": term_weights}


def _cat_case(x: str) -> str:
    parts = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in BROAD_CATEGORIES)
    return f"(CASE {parts} ELSE '{UNKNOWN_CATEGORY}' END)"


_BASE_SQL = f"""
WITH w AS (
  SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1))) AS terms FROM documents
), t AS (
  SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM w
), freq AS (
  SELECT term, count(*) AS frequency, 1.0 / count(*) AS weight FROM t GROUP BY term
), chars AS (
  SELECT term, unnest(string_split(term, '')) AS ch, generate_subscripts(string_split(term, ''), 1) AS p FROM freq
), letter_counts AS (
  SELECT term, upper(ch) AS l, count(*) AS n, min(p) AS fp FROM chars GROUP BY term, upper(ch)
), best AS (
  SELECT term, arg_max(l, (n, -fp)) AS letter FROM letter_counts GROUP BY term
), rows AS (
  SELECT t.doc_id, t.pos, t.term, f.weight, {_cat_case('b.letter')} AS category
  FROM t JOIN freq f ON t.term = f.term JOIN best b ON t.term = b.term
), per_w AS (
  SELECT doc_id, category, round(sum(weight), 12) AS s, min(pos) AS fp FROM rows GROUP BY doc_id, category
), by_w AS (
  SELECT doc_id, arg_max(category, (s, -fp)) AS weighted_category FROM per_w GROUP BY doc_id
), per_n AS (
  SELECT doc_id, category, count(*) AS n, min(pos) AS fp FROM rows GROUP BY doc_id, category
), by_n AS (
  SELECT doc_id, arg_max(category, (n, -fp)) AS top,
    arg_max(category, (n, -fp)) FILTER (WHERE category <> '{UNKNOWN_CATEGORY}') AS known
  FROM per_n GROUP BY doc_id
), counts AS (SELECT doc_id, count(*) AS n_terms FROM rows GROUP BY doc_id
), final AS (
  SELECT d.doc_id, coalesce(c.n_terms, 0) AS n_terms, coalesce(bw.weighted_category, '{UNKNOWN_WEIGHTED}') AS weighted_category,
    coalesce(CASE WHEN bn.top = '{UNKNOWN_CATEGORY}' AND bn.known IS NOT NULL THEN bn.known ELSE bn.top END, '{UNKNOWN_CATEGORY}') AS frequent_category
  FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN by_w bw ON d.doc_id = bw.doc_id
  LEFT JOIN by_n bn ON d.doc_id = bn.doc_id
)"""


_WEIGHTS_SQL = (
    _BASE_SQL[: _BASE_SQL.index("), rows AS (")].replace("FROM documents", "FROM d", 1).replace("WITH w AS", "WITH d AS (SELECT item_id AS doc_id, text FROM benchmark), w AS", 1)
    + f""")
, dw AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1))) AS terms FROM documents
), dt AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM dw)
SELECT dt.doc_id, CAST(dt.pos AS INTEGER) AS pos, dt.term, coalesce(f.weight, 0.0) AS weight, CASE WHEN b.letter IS NULL THEN '{UNKNOWN_CATEGORY}' ELSE {_cat_case('b.letter')} END AS category
FROM dt LEFT JOIN freq f ON dt.term = f.term LEFT JOIN best b ON dt.term = b.term"""
)


def oracles() -> dict[str, str]:
    return {
        "term_weights": _WEIGHTS_SQL,
        "term_categories": _BASE_SQL + " SELECT * FROM final",
        "category_distribution": _BASE_SQL + " SELECT weighted_category, count(*) AS count FROM final GROUP BY weighted_category",
    }
