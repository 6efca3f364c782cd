"""Guideline rules: render, rank, validate, number, cite.

Each operator has an array form (rules nested in their record: map-only,
no shuffle) and, where a Spark user would want it, a row form over an
exploded rules table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import parse_json_object, typed_fields
from ..functions.text import col_of, py_strip
from .ordering import numbered_within

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for parity).
# Recommendation class inferred from a source statement: first match wins.
RECOMMENDATION_PATTERNS = [
    (r"\bnot recommended\b", "NOT_RECOMMENDED"),
    (r"\bno recommendation(?: possible)?\b", "NO_RECOMMENDATION"),
    (r"\binsufficient evidence\b", "NO_RECOMMENDATION"),
    (r"\bmay be considered\b", "CONDITIONAL_CONSIDER"),
    (r"\bonly (?:within|in) (?:a )?clinical[- ]trial\b", "CONDITIONAL_CONSIDER"),
    (r"\brecommended\b", "RECOMMENDED"),
]
# Scenario inferred from a source statement: first match wins.
SCENARIO_PATTERNS = [
    (r"initial diagnosis|primary diagnosis", "INITIAL_DIAGNOSIS"),
    (r"pre[- ]operative staging|\bstaging\b", "PREOP_STAGING"),
    (r"assessment of treatment response|treatment response|response", "TREATMENT_RESPONSE"),
    (r"recurrence|restaging", "RECURRENCE_OR_RESTAGING"),
    (r"solitary metastasis", "SOLITARY_METASTASIS_AT_RECURRENCE"),
]
ALLOWED_SCENARIOS = [
    "INITIAL_DIAGNOSIS",
    "PREOP_STAGING",
    "TREATMENT_RESPONSE",
    "RECURRENCE_OR_RESTAGING",
    "SOLITARY_METASTASIS_AT_RECURRENCE",
    "GENERAL",
    "GLOBAL",
]
ALLOWED_RECOMMENDATION_CLASSES = [
    "RECOMMENDED",
    "NOT_RECOMMENDED",
    "CONDITIONAL_CONSIDER",
    "NO_RECOMMENDATION",
    "APPEND_QUALIFIER",
    "APPEND_SAFETY",
]
# Priority by class; any other class gets 40.
CLASS_PRIORITY = [
    ("NOT_RECOMMENDED", 80),
    ("RECOMMENDED", 70),
    ("CONDITIONAL_CONSIDER", 60),
    ("NO_RECOMMENDATION", 50),
]
DEFAULT_PRIORITY = 40
# Execute text derived from the class when a rule has none: prefix + statement.
EXECUTE_PREFIX = [
    ("NOT_RECOMMENDED", "Do not perform as routine practice. Basis: "),
    ("RECOMMENDED", "Recommend use in this scenario. Basis: "),
    ("CONDITIONAL_CONSIDER", "Consider only under stated conditions. Basis: "),
    ("NO_RECOMMENDATION", "No recommendation due to limited or absent evidence. Basis: "),
]
DEFAULT_EXECUTE_PREFIX = "Review clinically. Basis: "
# The two global wrapper rules appended to every rule set.
WRAPPER_RULES = [
    {
        "scenario": "GLOBAL",
        "priority": 20,
        "activation_condition": "always=true",
        "recommendation_class": "APPEND_QUALIFIER",
        "execute": (
            "Append evidence-quality qualifier: recommendations may be limited by "
            "heterogeneity, small sample sizes, and limited randomized evidence."
        ),
        "source_statement": "system_generated_global_evidence_note",
    },
    {
        "scenario": "GLOBAL",
        "priority": 10,
        "activation_condition": "always=true",
        "recommendation_class": "APPEND_SAFETY",
        "execute": (
            "Append safety notice: this is decision support and does not replace "
            "specialist clinical judgment."
        ),
        "source_statement": "system_generated_global_safety_note",
    },
]
# Lines of a rendered rule: label, field, default.
RENDER_FIELDS = [
    ("Rule ID", "rule_id", "UNKNOWN"),
    ("Scenario", "scenario", "UNKNOWN"),
    ("Priority", "priority", "UNKNOWN"),
    ("Recommendation Class", "recommendation_class", "UNKNOWN"),
    ("Activation Condition", "activation_condition", ""),
    ("Guideline Action", "execute", ""),
    ("Source Statement", "source_statement", ""),
]
# What stands in for a missing statement and a missing condition.
DEFAULT_STATEMENT = "llm_generated_rule"
DEFAULT_CONDITION_PREFIX = "scenario="
# ---------------------------------------------------------------------------

RULE_FIELDS = [
    "rule_id",
    "scenario",
    "priority",
    "activation_condition",
    "recommendation_class",
    "execute",
    "source_statement",
]


def render_rule(r: Column) -> Column:
    """P4 for one rule struct: 7 labelled lines."""
    lines = []
    for label, field, default in RENDER_FIELDS:
        v = F.coalesce(r[field].cast("string"), F.lit(default))
        lines.append(F.concat(F.lit(f"{label}: "), v))
    return F.concat_ws("\n", *lines)


def render_rules(rules) -> Column:
    """Rules array to one text block, rules separated by a blank line."""
    r = col_of(rules)
    return F.array_join(F.transform(F.coalesce(r, F.array()), render_rule), "\n\n")


def rule_order_key(r: Column) -> Column:
    return F.struct((-r["priority"]).alias("p"), r["rule_id"].alias("id"))


def top_rules_array(rules, k: int = 8) -> Column:
    """W1 (array form): by priority desc, then rule_id; keep k."""
    r = col_of(rules)
    sorted_r = F.array_sort(
        r,
        lambda a, b: F.when(F.coalesce(a["priority"], F.lit(-(2**31))) > F.coalesce(b["priority"], F.lit(-(2**31))), -1)
        .when(F.coalesce(a["priority"], F.lit(-(2**31))) < F.coalesce(b["priority"], F.lit(-(2**31))), 1)
        .when(a["rule_id"] < b["rule_id"], -1)
        .when(a["rule_id"] > b["rule_id"], 1)
        .otherwise(0),
    )
    return F.slice(sorted_r, 1, k)


def top_rules(rules: DataFrame, record: str, k: int = 8, priority: str = "priority", rule_id: str = "rule_id") -> DataFrame:
    """W1 (row form): the k best rules per record.

    ``row_number() <= k`` lets Spark insert a per-partition WindowGroupLimit
    before the shuffle, so each map task ships at most k rows per record and
    a record holding a third of all rules costs no more than any other.
    """
    w = Window.partitionBy(record).orderBy(F.col(priority).desc_nulls_last(), F.col(rule_id))
    return rules.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _first_match(text: Column, patterns) -> Column:
    out = F.lit(None).cast("string")
    for pat, value in reversed(patterns):
        out = F.when(text.rlike("(?i)" + pat), F.lit(value)).otherwise(out)
    return out


def infer_scenario(statement) -> Column:
    return F.coalesce(_first_match(F.lower(F.coalesce(col_of(statement), F.lit(""))), SCENARIO_PATTERNS), F.lit("GENERAL"))


def infer_recommendation_class(statement) -> Column:
    return _first_match(F.lower(F.coalesce(col_of(statement), F.lit(""))), RECOMMENDATION_PATTERNS)


def _by_class(cls: Column, table, default) -> Column:
    out = F.lit(default)
    for name, value in reversed(table):
        out = F.when(cls == name, F.lit(value)).otherwise(out)
    return out


def priority_for_class(cls) -> Column:
    return _by_class(col_of(cls), CLASS_PRIORITY, DEFAULT_PRIORITY)


def normalize_rule(r: Column) -> Column:
    """F7 for one raw rule struct; null when its class cannot be settled
    (the rule is dropped). ``rule_id`` is left null for W2 to number.

    A null scenario counts as a missing one and becomes GENERAL: in a typed
    column the two are the same, and a missing key is the common case. Any
    other text outside the allowed set is inferred from the statement."""
    stmt_raw = F.coalesce(r["source_statement"].cast("string"), F.lit(""))
    scen = F.upper(py_strip(F.coalesce(r["scenario"].cast("string"), F.lit("GENERAL"))))
    scen = F.when(scen.isin(*ALLOWED_SCENARIOS), scen).otherwise(infer_scenario(stmt_raw))
    cls = F.upper(py_strip(F.coalesce(r["recommendation_class"].cast("string"), F.lit(""))))
    cls = F.when(cls.isin(*ALLOWED_RECOMMENDATION_CLASSES), cls).otherwise(infer_recommendation_class(stmt_raw))
    act = py_strip(F.coalesce(r["activation_condition"].cast("string"), F.lit("")))
    act = F.when(act == "", F.concat(F.lit(DEFAULT_CONDITION_PREFIX), scen)).otherwise(act)
    stmt = py_strip(stmt_raw)
    stmt = F.when(stmt == "", F.lit(DEFAULT_STATEMENT)).otherwise(stmt)
    exe = py_strip(F.coalesce(r["execute"].cast("string"), F.lit("")))
    exe = F.when(exe == "", F.concat(_by_class(cls, EXECUTE_PREFIX, DEFAULT_EXECUTE_PREFIX), stmt)).otherwise(exe)
    rule = F.struct(
        F.lit(None).cast("string").alias("rule_id"),
        scen.alias("scenario"),
        priority_for_class(cls).cast("int").alias("priority"),
        act.alias("activation_condition"),
        cls.alias("recommendation_class"),
        exe.alias("execute"),
        stmt.alias("source_statement"),
    )
    return F.when(cls.isNotNull(), rule)


def rule_id_text(n: Column) -> Column:
    return F.format_string("R%03d", n)


def validate_rules_array(raw_rules) -> Column:
    """F7 + numbering: valid rules numbered R001.. in input order."""
    valid = F.filter(F.transform(col_of(raw_rules), normalize_rule), lambda x: x.isNotNull())
    return F.transform(valid, lambda x, i: x.withField("rule_id", rule_id_text(i + 1)))


def _wrapper_struct(w: dict, n: Column) -> Column:
    return F.struct(
        rule_id_text(n).alias("rule_id"),
        F.lit(w["scenario"]).alias("scenario"),
        F.lit(w["priority"]).alias("priority"),
        F.lit(w["activation_condition"]).alias("activation_condition"),
        F.lit(w["recommendation_class"]).alias("recommendation_class"),
        F.lit(w["execute"]).alias("execute"),
        F.lit(w["source_statement"]).alias("source_statement"),
    )


def number_rules_array(raw_rules) -> Column:
    """W2 (array form): F7, number, append the 2 wrappers, sort by priority
    desc then id (text order), renumber R001.."""
    valid = validate_rules_array(raw_rules)
    n = F.size(valid)
    allr = F.concat(valid, F.array(_wrapper_struct(WRAPPER_RULES[0], n + 1), _wrapper_struct(WRAPPER_RULES[1], n + 2)))
    srt = F.array_sort(
        allr,
        lambda a, b: F.when(a["priority"] > b["priority"], -1)
        .when(a["priority"] < b["priority"], 1)
        .when(a["rule_id"] < b["rule_id"], -1)
        .when(a["rule_id"] > b["rule_id"], 1)
        .otherwise(0),
    )
    return F.transform(srt, lambda x, i: x.withField("rule_id", rule_id_text(i + 1)))


def number_rules(raw: DataFrame, record: str, pos: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """W2 (row form) over an exploded raw-rules table ``(record, pos, rule fields)``.

    Valid rules are numbered by input position, two wrapper rows are added
    per record (one row per record from a grouped count: algebraic), then all
    rules are renumbered by (priority desc, id text). Both numberings are
    places in a range-sorted global order less the record's first, so a
    record with a third of all rules spreads over many tasks, and ids of any
    length are compared as the text they are.
    """
    rule = normalize_rule(F.struct(*[F.col(c) for c in RULE_FIELDS if c != "rule_id"], F.lit(None).alias("rule_id")))
    valid = raw.select(record, pos, rule.alias("r")).filter(F.col("r").isNotNull())
    valid = numbered_within(valid, [record], [F.col(pos)], "_k", rows_per_task)
    valid = valid.select(record, F.col("r").withField("rule_id", rule_id_text(F.col("_k"))).alias("r"))
    counts = raw.select(record).distinct().join(
        valid.groupBy(record).agg(F.count("*").alias("n")), record, "left"
    ).select(record, F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    wrappers = counts.select(
        record,
        F.explode(F.array(_wrapper_struct(WRAPPER_RULES[0], F.col("n") + 1), _wrapper_struct(WRAPPER_RULES[1], F.col("n") + 2))).alias("r"),
    )
    allr = valid.unionByName(wrappers).select(record, "r.*")
    ranked = numbered_within(allr, [record], [F.col("priority").desc(), F.col("rule_id")], "_w", rows_per_task)
    return ranked.withColumn("rule_id", rule_id_text(F.col("_w"))).drop("_w")


# Action phrasings that give a near miss away.
HINTING_ACTION_PHRASES = ["as if", "as though"]
DIFFICULTY_LEVELS = ["easy", "medium", "hard"]


def _clean_list(arr: Column) -> Column:
    return F.filter(F.transform(F.coalesce(arr, F.array()), lambda a: py_strip(a)), lambda a: a != "")


def validate_near_misses(examples, rules) -> Column:
    """F8 (near-miss form): per example strip strings, keep only cited ids
    in the supplied rules (J4), drop blank actions and likely actions with
    a hinting phrase, force DISCORDANT, difficulty in easy / medium / hard
    else medium; examples with a blank vignette are dropped."""
    valid = F.transform(F.coalesce(col_of(rules), F.array()), lambda r: r["rule_id"])

    def one(e):
        diff = F.lower(py_strip(F.coalesce(e["difficulty"], F.lit("medium"))))
        likely = F.filter(
            _clean_list(e["likely_but_incorrect_actions"]),
            lambda a: ~F.exists(F.array(*[F.lit(p) for p in HINTING_ACTION_PHRASES]), lambda p: F.lower(a).contains(p)),
        )
        return F.struct(
            py_strip(F.coalesce(e["patient_vignette"], F.lit(""))).alias("patient_vignette"),
            F.filter(F.coalesce(e["invalidated_rule_ids"], F.array()), lambda x: F.array_contains(valid, x)).alias("invalidated_rule_ids"),
            F.filter(F.coalesce(e["triggered_rule_ids"], F.array()), lambda x: F.array_contains(valid, x)).alias("triggered_rule_ids"),
            py_strip(F.coalesce(e["deceptive_similarity"], F.lit(""))).alias("deceptive_similarity"),
            likely.alias("likely_but_incorrect_actions"),
            _clean_list(e["recommended_actions"]).alias("recommended_actions"),
            py_strip(F.coalesce(e["corrected_assessment"], F.lit(""))).alias("corrected_assessment"),
            py_strip(F.coalesce(e["rationale"], F.lit(""))).alias("rationale"),
            F.lit("DISCORDANT").alias("true_guideline_concordance"),
            F.when(diff.isin(*DIFFICULTY_LEVELS), diff).otherwise(F.lit("medium")).alias("difficulty"),
        )

    return F.filter(F.transform(F.coalesce(col_of(examples), F.array()), one), lambda x: x["patient_vignette"] != "")


def validate_vignette(case, rules) -> Column:
    """F8 (vignette form): strip, keep cited ids in the rules, drop blank actions."""
    c = col_of(case)
    valid = F.transform(F.coalesce(col_of(rules), F.array()), lambda r: r["rule_id"])
    return F.struct(
        py_strip(F.coalesce(c["patient_vignette"], F.lit(""))).alias("patient_vignette"),
        F.filter(F.coalesce(c["triggered_rule_ids"], F.array()), lambda x: F.array_contains(valid, x)).alias("triggered_rule_ids"),
        _clean_list(c["recommended_actions"]).alias("recommended_actions"),
        py_strip(F.coalesce(c["rationale"], F.lit(""))).alias("rationale"),
    )


#: Typed fields of a vignette reply.
VIGNETTE_FIELDS = {"patient_vignette": "string", "triggered_rule_ids": "array<string>", "recommended_actions": "array<string>", "rationale": "string"}


def vignettes_from_replies(replies: DataFrame, reply: str, rules: str, out: str = "vignette", fenced: bool = False) -> DataFrame:
    """F6 + F8 as a job: the JSON object of each reply, typed, then validated
    against the row's ``rules``; null where a reply has no object or its
    vignette is blank."""
    staged = replies.withColumn("_object", parse_json_object(reply, fenced))
    staged = staged.withColumn("_typed", typed_fields("_object", VIGNETTE_FIELDS))
    staged = staged.withColumn("_valid", validate_vignette("_typed", rules))
    ok = F.col("_object").isNotNull() & (F.col("_valid.patient_vignette") != "")
    return staged.withColumn(out, F.when(ok, F.col("_valid"))).drop("_object", "_typed", "_valid")


def explode_rules(records: DataFrame, rules: str = "rules", keys=("record_index",)) -> DataFrame:
    """One row per rule with its position; records without rules keep
    one row with null rule fields (``posexplode_outer``)."""
    return records.select(*keys, F.posexplode_outer(F.col(rules)).alias("rule_pos", "rule")).select(
        *keys, "rule_pos", "rule.*"
    )


def extraction_method_counts(specs: DataFrame, method: str = "rule_spec.engine_metadata.extraction_method") -> DataFrame:
    """How many records each extraction method produced (``llm``,
    ``llm_no_valid_rules``, ``llm_failed``); one algebraic count."""
    return specs.groupBy(F.col(method).alias("extraction_method")).agg(F.count("*").alias("count"))


def cited_rules_array(ids, rules) -> Column:
    """Keep cited ids present in the supplied rules; order and repeats kept."""
    valid = F.transform(col_of(rules), lambda r: r["rule_id"])
    return F.filter(col_of(ids), lambda x: F.array_contains(valid, x))


def cited_rules(citations: DataFrame, rules: DataFrame, keys) -> DataFrame:
    """J4 (row form): left-semi join of exploded citations on (record, rule id)."""
    return citations.join(rules.select(*keys), list(keys), "left_semi")
