"""Per-case diagnostics of action predictions (F12) and re-scoring of saved
predictions (A16). Pure column expressions over a matches table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..functions.text import py_strip

# Diagnostic labels and summary phrases.
EXACT_SUMMARY = "Prediction exactly matched the reference action set."
UNUSABLE_NOTE = "model output did not yield a usable recommended_actions list"
EMPTY_NOTE = "model returned no output"
MATCHED_NOTE = "Matched %d of %d reference actions"
NONE_MATCHED_NOTE = "Matched 0 reference actions"
MISSED_PREFIX = "missed: "
EXTRA_PREFIX = "extra: "

# The 28 diagnostic columns, in published order.
DIAGNOSTIC_COLUMNS = [
    "model_name", "guideline_id", "guideline_title", "case_id", "case_kind", "decision", "diagnostic_label",
    "diagnostic_summary", "action_precision", "action_recall", "action_f1", "average_match_score",
    "num_generated_actions", "num_reference_actions", "num_matched_actions", "num_unmatched_generated_actions",
    "num_unmatched_reference_actions", "original_reference_actions_text", "reference_actions_text",
    "redundant_reference_actions_text", "generated_actions_text", "matched_actions_text",
    "missed_reference_actions_text", "hallucinated_actions_text", "matched_pairs_text", "reference_rule_ids_text",
    "patient_vignette", "raw_model_output",
]


def summarize_actions(arr) -> Column:
    """Non-blank actions, stripped, joined with `` | ``."""
    a = F.col(arr) if isinstance(arr, str) else arr
    items = F.filter(F.transform(F.coalesce(a, F.array()), lambda x: py_strip(x)), lambda x: x != "")
    return F.array_join(items, " | ")


def diagnose(m: DataFrame) -> DataFrame:
    """label = ``correct`` or the ``+``-joined issues, plus a prose summary.

    ``m`` is a matches table (``match_metrics`` output) with
    ``raw_model_output``. Counts are columns and lists stay arrays (Q8).
    """
    raw = F.coalesce(py_strip(F.col("raw_model_output")), F.lit(""))
    ng = F.size(F.coalesce(F.col("generated_actions"), F.array()))
    nr = F.size(F.coalesce(F.col("reference_actions"), F.array()))
    empty_output = raw == ""
    unparseable = (raw != "") & (ng == 0)
    missed = F.col("num_unmatched_reference_actions") > 0
    extra = F.col("num_unmatched_generated_actions") > 0
    issues = F.concat_ws(
        "+",
        F.when(empty_output, F.lit("empty_output")),
        F.when(unparseable, F.lit("unparseable_or_empty_action_list")),
        F.when(missed, F.lit("missed_reference_actions")),
        F.when(extra, F.lit("hallucinated_actions")),
    )
    label = F.when(F.col("exact_match") == 1, F.lit("correct")).when(issues == "", F.lit("partial_semantic_mismatch")).otherwise(issues)
    n_pairs = F.size(F.coalesce(F.col("matched_pairs"), F.array()))
    first = F.when(
        n_pairs > 0, F.format_string(MATCHED_NOTE, F.col("num_matched_actions"), nr)
    ).otherwise(F.lit(NONE_MATCHED_NOTE))
    summary = F.concat_ws(
        "; ",
        first,
        F.when(F.size("unmatched_reference_actions") > 0, F.concat(F.lit(MISSED_PREFIX), summarize_actions("unmatched_reference_actions"))),
        F.when(F.size("unmatched_generated_actions") > 0, F.concat(F.lit(EXTRA_PREFIX), summarize_actions("unmatched_generated_actions"))),
        F.when(unparseable, F.lit(UNUSABLE_NOTE)),
        F.when(empty_output, F.lit(EMPTY_NOTE)),
    )
    summary = F.when(F.col("exact_match") == 1, F.lit(EXACT_SUMMARY)).otherwise(summary)
    pairs_text = F.array_join(
        F.transform(
            F.coalesce(F.col("matched_pairs"), F.array()),
            lambda p: F.format_string("%s => %s (%.3f)", p["generated_action"], p["reference_action"], p["score"]),
        ),
        " | ",
    )
    return (
        m.withColumn("diagnostic_label", label)
        .withColumn("diagnostic_summary", summary)
        .withColumn("matched_actions_text", summarize_actions("matched_generated_actions"))
        .withColumn("missed_reference_actions_text", summarize_actions("unmatched_reference_actions"))
        .withColumn("hallucinated_actions_text", summarize_actions("unmatched_generated_actions"))
        .withColumn("generated_actions_text", summarize_actions("generated_actions"))
        .withColumn("reference_actions_text", summarize_actions("reference_actions"))
        .withColumn("matched_pairs_text", pairs_text)
    )


def diagnostic_projection(d: DataFrame) -> DataFrame:
    """The 28-column diagnostics table; absent optional columns are empty."""
    cols = []
    for c in DIAGNOSTIC_COLUMNS:
        cols.append(F.col(c) if c in d.columns else F.lit("").alias(c))
    return d.select(*cols)


def _without(items: Column, used: Column) -> Column:
    """Items that are not used, repeats kept: each item is looked up in a map
    of the used ones instead of being compared with all of them."""
    distinct = F.array_distinct(used)
    known = F.map_from_arrays(distinct, F.transform(distinct, lambda x: F.lit(True)))
    return F.get(F.transform(F.array(known), lambda m: F.filter(items, lambda x: F.try_element_at(m, x).isNull())), F.lit(0))


def rescore_saved(pred: DataFrame, kept_pairs: DataFrame | None = None) -> DataFrame:
    """Re-score saved predictions on the diagnostics-only path.

    ``pred`` holds generated_actions, reference_actions (after
    de-duplication) and matched_pairs. Pairs whose reference action did not
    survive de-duplication are dropped (J8); unmatched lists are recomputed
    by text, so repeated texts collapse; empties give P = R = F1 = 0 while
    exact is 1 when both lists are empty (Q6).
    """
    ref = F.coalesce(F.col("reference_actions"), F.array())
    gen = F.coalesce(F.col("generated_actions"), F.array())
    pairs = F.filter(F.coalesce(F.col("matched_pairs"), F.array()), lambda p: F.array_contains(ref, p["reference_action"]))
    mg = F.transform(pairs, lambda p: p["generated_action"])
    mr = F.transform(pairs, lambda p: p["reference_action"])
    out = (
        pred.withColumn("matched_pairs", pairs)
        .withColumn("unmatched_generated_actions", _without(gen, mg))
        .withColumn("unmatched_reference_actions", _without(ref, mr))
        .withColumn("num_matched_actions", F.size(pairs))
        .withColumn("num_generated_actions", F.size(gen))
        .withColumn("num_reference_actions", F.size(ref))
    )
    n, ng, nr = F.col("num_matched_actions"), F.col("num_generated_actions"), F.col("num_reference_actions")
    p, r = safe_div(n, ng), safe_div(n, nr)
    return (
        out.withColumn("action_precision", p)
        .withColumn("action_recall", r)
        .withColumn("action_f1", safe_div(2 * F.col("action_precision") * F.col("action_recall"), F.col("action_precision") + F.col("action_recall")))
        .withColumn("exact_match", ((n == ng) & (n == nr)).cast("int"))
        .withColumn(
            "average_match_score",
            F.when(n > 0, F.aggregate(F.transform(pairs, lambda q: q["score"]), F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0),
        )
        .withColumn("num_unmatched_generated_actions", F.size("unmatched_generated_actions"))
        .withColumn("num_unmatched_reference_actions", F.size("unmatched_reference_actions"))
    )
