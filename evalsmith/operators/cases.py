"""Nested guideline records to one row per judgeable case.

Covers P1, P5-P9, P12, X1-X3 and O1. Records stay nested (structs and
arrays of structs); flattening is ``posexplode`` per record, so this is a
map-only stage: no shuffle, and a record's examples never leave its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.replies import keep_first_distinct
from ..functions.text import blank_to_null, bullet_list, py_strip
from .rules import render_rules

# Classes that only wrap a decision and are not actionable.
WRAPPER_CLASSES = ["APPEND_QUALIFIER", "APPEND_SAFETY"]


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def _record_index_text() -> Column:
    return F.coalesce(F.col("guideline.record_index").cast("string"), F.lit("unknown"))


def _guideline_cols() -> list[Column]:
    return [
        F.col("guideline.record_index").alias("record_index"),
        F.coalesce(F.col("guideline.id"), F.lit("")).alias("guideline_id"),
        F.coalesce(F.col("guideline.source"), F.lit("")).alias("guideline_source"),
        F.coalesce(F.col("guideline.title"), F.lit("")).alias("guideline_title"),
    ]


def _nonblank(c: Column) -> Column:
    return F.coalesce(py_strip(c), F.lit("")) != ""


def _rules_text(records: DataFrame) -> Column:
    if "selected_rules" in records.columns:
        return render_rules(F.col("selected_rules"))
    return F.lit("")


def concordant_cases(records: DataFrame, payload: str = "generated_case") -> DataFrame:
    """One concordant case per record from ``generated_case`` (own file)
    or ``source_case`` (adversarial file); label 0, id ``{record_index}_source``.
    P12: blank vignette or empty action list drops the row."""
    p = F.col(payload)
    return records.filter(
        _nonblank(p["patient_vignette"]) & (F.coalesce(F.size(p["recommended_actions"]), F.lit(0)) > 0)
    ).select(
        *_guideline_cols(),
        F.concat(_record_index_text(), F.lit("_source")).alias("case_id"),
        F.lit("source_case").alias("case_kind"),
        F.lit("concordant").alias("difficulty"),
        F.lit(0).alias("label"),
        py_strip(p["patient_vignette"]).alias("patient_vignette"),
        p["recommended_actions"].alias("proposed_actions"),
        F.coalesce(p["triggered_rule_ids"], F.array().cast("array<string>")).alias("reference_rule_ids"),
        _rules_text(records).alias("rules_text"),
    )


def near_miss_cases(records: DataFrame) -> DataFrame:
    """One case per ``challenging_examples`` element; label 1; difficulty
    lower-cased (default ``medium``); id ``{record_index}_adv_{pos}`` where
    ``pos`` counts skipped elements too (posexplode before filtering)."""
    ex = records.select(
        "*", F.posexplode(F.coalesce(F.col("challenging_examples"), F.array())).alias("_pos", "_ex")
    )
    e = F.col("_ex")
    diff = F.lower(py_strip(F.coalesce(e["difficulty"], F.lit("medium"))))
    return ex.filter(
        e.isNotNull() & _nonblank(e["patient_vignette"])
        & (F.coalesce(F.size(e["likely_but_incorrect_actions"]), F.lit(0)) > 0)
    ).select(
        *_guideline_cols(),
        F.concat(_record_index_text(), F.lit("_adv_"), F.col("_pos").cast("string")).alias("case_id"),
        F.lit("challenging_example").alias("case_kind"),
        F.when(diff == "", "medium").otherwise(diff).alias("difficulty"),
        F.lit(1).alias("label"),
        py_strip(e["patient_vignette"]).alias("patient_vignette"),
        e["likely_but_incorrect_actions"].alias("proposed_actions"),
        F.coalesce(e["invalidated_rule_ids"], F.array().cast("array<string>")).alias("reference_rule_ids"),
        _rules_text(records).alias("rules_text"),
    )


def guideline_cases(records: DataFrame, payload: str = "source_case") -> DataFrame:
    """X1, X2 and O1 in one pass over the records: the concordant case and the
    near-miss cases of each record, which is built and read once."""
    p, ex = F.col(payload), F.coalesce(F.col("challenging_examples"), F.array())
    no_ids = F.array().cast("array<string>")

    def one(v, actions, ids, difficulty, pos):
        return F.struct(
            v.alias("vignette"), actions.alias("actions"), F.coalesce(ids, no_ids).alias("ids"),
            F.lower(py_strip(F.coalesce(difficulty, F.lit("medium")))).alias("difficulty"), pos.cast("int").alias("pos"),
        )

    base = one(p["patient_vignette"], p["recommended_actions"], p["triggered_rule_ids"], F.lit("concordant"), F.lit(-1))
    others = F.transform(ex, lambda e, i: one(e["patient_vignette"], e["likely_but_incorrect_actions"], e["invalidated_rule_ids"], e["difficulty"], i))
    staged = records.select(*_guideline_cols(), _record_index_text().alias("_index"), _rules_text(records).alias("rules_text"), F.concat(F.array(base), others).alias("_cases"))
    c, is_base = F.col("_c"), F.col("_c.pos") < 0
    return (
        staged.select("*", F.explode("_cases").alias("_c"))
        .where(_nonblank(c["vignette"]) & (F.coalesce(F.size(c["actions"]), F.lit(0)) > 0))
        .select(
            "record_index", "guideline_id", "guideline_source", "guideline_title",
            F.concat("_index", F.when(is_base, F.lit("_source")).otherwise(F.concat(F.lit("_adv_"), c["pos"].cast("string")))).alias("case_id"),
            F.when(is_base, "source_case").otherwise("challenging_example").alias("case_kind"),
            F.when(c["difficulty"] == "", "medium").otherwise(c["difficulty"]).alias("difficulty"),
            F.when(is_base, 0).otherwise(1).alias("label"),
            py_strip(c["vignette"]).alias("patient_vignette"),
            c["actions"].alias("proposed_actions"),
            c["ids"].alias("reference_rule_ids"),
            "rules_text",
        )
    )


def all_cases(concordant: DataFrame, near_miss: DataFrame, require_rows: bool = False) -> DataFrame:
    """O1: concordant rows then near-miss rows, duplicates kept.

    ``require_rows=True`` raises when both are empty (one ``isEmpty`` probe,
    which reads at most one row)."""
    out = concordant.unionByName(near_miss)
    if require_rows and out.isEmpty():
        raise ValueError("No valid guideline cases were found after flattening the inputs.")
    return out


def action_text_columns(df: DataFrame, actions: str = "proposed_actions", drop_blank: bool = True) -> DataFrame:
    """Bullet list of actions and comma-joined rule ids as text."""
    return df.withColumn(f"{actions}_text", bullet_list(actions, drop_blank=drop_blank)).withColumn(
        "reference_rule_ids_text", F.array_join(F.coalesce(F.col("reference_rule_ids"), F.array()), ", ")
    )


def _clean_actions(arr: Column) -> Column:
    """Strip, drop blanks, then W6."""
    stripped = F.filter(F.transform(arr, lambda a: py_strip(a)), lambda a: a != "")
    return keep_first_distinct(stripped)


def reference_cases(records: DataFrame, keep_orphan_examples: bool = False) -> DataFrame:
    """Cases with reference actions for the action-generation task.

    Base case: ``generated_case`` if present, else ``source_case``; dropped
    when its vignette is blank, its action list missing, or no action is
    left after cleaning. Examples: every ``challenging_examples`` element
    with a vignette and an action list (an empty cleaned list is kept). If
    the base case is dropped, its examples are dropped too (Q7) unless
    ``keep_orphan_examples``. One pass: a record's base case, its cleaned
    actions and its examples are each made once, then exploded.
    """
    gen = F.col("generated_case") if "generated_case" in records.columns else F.lit(None)
    src = F.col("source_case") if "source_case" in records.columns else F.lit(None)
    ex = F.col("challenging_examples") if "challenging_examples" in records.columns else F.lit(None).cast("array<struct<patient_vignette:string,recommended_actions:array<string>,triggered_rule_ids:array<string>>>")
    no_ids = F.array().cast("array<string>")

    def one(kind, vignette, actions, ids, pos):
        return F.struct(kind.alias("kind"), vignette.alias("vignette"), actions.alias("actions"), F.coalesce(ids, no_ids).alias("ids"), pos.cast("int").alias("pos"))

    staged = records.select(
        *_guideline_cols(),
        _record_index_text().alias("_index"),
        _rules_text(records).alias("rules_text"),
        F.when(gen.isNotNull(), "generated_case").otherwise("source_case").alias("_kind"),
        F.coalesce(gen, src).alias("_base"),
        F.coalesce(ex, F.array()).alias("_examples"),
    ).withColumn("_clean", _clean_actions(F.col("_base.recommended_actions")))
    base_ok = F.coalesce(_nonblank(F.col("_base.patient_vignette")) & (F.size("_clean") > 0), F.lit(False))
    base = one(F.col("_kind"), F.col("_base.patient_vignette"), F.col("_clean"), F.col("_base.triggered_rule_ids"), F.lit(-1))
    usable = F.filter(
        F.transform("_examples", lambda e, i: F.struct(e.alias("e"), i.alias("i"))),
        lambda x: _nonblank(x["e"]["patient_vignette"]) & x["e"]["recommended_actions"].isNotNull(),
    )
    others = F.transform(
        usable,
        lambda x: one(F.lit("challenging_example"), x["e"]["patient_vignette"], _clean_actions(x["e"]["recommended_actions"]), x["e"]["triggered_rule_ids"], x["i"]),
    )
    none = F.filter(F.array(base), lambda _: F.lit(False))
    cases = F.when(base_ok, F.concat(F.array(base), others)).otherwise(others if keep_orphan_examples else none)
    c = F.col("_c")
    return staged.select("*", F.explode(cases).alias("_c")).select(
        "record_index", "guideline_id", "guideline_source", "guideline_title",
        F.concat("_index", F.lit("_"), c["kind"], F.when(c["pos"] < 0, F.lit("")).otherwise(F.concat(F.lit("_"), c["pos"].cast("string")))).alias("case_id"),
        c["kind"].alias("case_kind"),
        py_strip(c["vignette"]).alias("patient_vignette"),
        c["actions"].alias("reference_actions"),
        c["ids"].alias("reference_rule_ids"),
        "rules_text",
        F.array_join(F.transform(c["actions"], lambda a: F.concat(F.lit("- "), a)), "\n").alias("reference_actions_text"),
        F.array_join(c["ids"], ", ").alias("reference_rule_ids_text"),
    )


def select_index_range(df: DataFrame, start: int, end: int, col: str = "guideline.record_index") -> DataFrame:
    """P5: inclusive range on the record index (pushed to the scan when the
    column is top-level); a non-integer index is dropped."""
    if end < start:
        raise ValueError("end must be >= start")
    idx = F.col(col)
    # A cast would keep the filter from the scan: integers are compared as they are.
    if not isinstance(df.select(idx).schema[0].dataType, (T.IntegerType, T.LongType, T.ShortType)):
        idx = idx.try_cast("long")
    return df.filter(idx.isNotNull() & idx.between(start, end))


def is_actionable(recommendation_class: Column) -> Column:
    """Whether a rule of this class is more than a wrapper of the decision; an
    unknown class counts as actionable."""
    return recommendation_class.isNull() | ~recommendation_class.isin(*WRAPPER_CLASSES)


def actionable_rules(rules) -> Column:
    """Drop wrapper-class rules from a rules array; no class is kept."""
    r = F.col(rules) if isinstance(rules, str) else rules
    return F.filter(
        r,
        lambda x: is_actionable(x["recommendation_class"]),
    )


def guideline_header(g="guideline") -> Column:
    """Metadata struct; title = title, else overview, else
    ``Untitled guideline`` (blank counts as missing); other defaults ``unknown``."""
    s = F.col(g) if isinstance(g, str) else g
    fields = [f for f in ("id", "source", "extraction_method")]
    title = F.coalesce(blank_to_null(s["title"]), F.lit("Untitled guideline"))
    return F.struct(
        s["record_index"].alias("record_index"),
        *[F.coalesce(blank_to_null(s[f]), F.lit("unknown")).alias(f) for f in fields],
        title.alias("title"),
    )


def header_with_overview(g="guideline") -> Column:
    """P7 when the record carries an overview: title, else overview."""
    s = F.col(g) if isinstance(g, str) else g
    return F.coalesce(blank_to_null(s["title"]), blank_to_null(s["overview"]), F.lit("Untitled guideline"))


def record_status(n_actionable, has_source_case, n_generated) -> Column:
    """Outcome of one generation record."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (
        F.when(c(n_actionable) == 0, "skipped_no_actionable_rules")
        .when(~c(has_source_case), "skipped_missing_source_case")
        .when(c(n_generated) > 0, "generated")
        .otherwise("empty_generation")
    )
