"""Priority-ordered decision table over a patient table.

The table is data (rule id, priority, type, class, condition, specificity);
each condition is a Spark SQL boolean expression, so evaluating every rule
for every patient is one projection: one boolean per rule, then array
functions pick the winner. No join, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The pancreatic PET decision table and its texts.
REQUIRED_FIELDS = ["clinical_scenario", "surgical_candidacy", "biopsy_status", "recurrence_status"]
OPTIONAL_FIELDS = [
    "positive_pet_would_change_to_curative_resection",
    "suspected_tumor_type",
    "post_resection_status",
    "care_context",
]
GATE_RULE = "R01"
WRAPPER_RULE_IDS = ["R12", "R13"]
MODIFIER_TEXT = "FDG-negative neuroendocrine disease possible; negative PET does not exclude disease"
EVIDENCE_NOTE = "Append heterogeneity/small-sample/limited-randomized-evidence disclaimer"
SAFETY_NOTE = "Append decision-support-only notice; log clinician override if discordant"
POLICY_VERSION = "1.0.0"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: int
    kind: str  # GATE / DECISION / MODIFIER / WRAPPER
    recommendation: str
    condition: str  # Spark SQL boolean expression over the patient columns
    specificity: int
    execute: str
    evidence_strength: str = ""
    notes: str = ""


PET_RULES = [
    Rule("R02", 90, "DECISION", "NOT_RECOMMENDED", "clinical_scenario = 'INITIAL_DIAGNOSIS'", 1,
         "Do not use PET/PET-CT for initial diagnosis; cite biopsy as gold standard"),
    Rule("R03", 85, "DECISION", "CONDITIONAL_CONSIDER",
         "clinical_scenario = 'INITIAL_DIAGNOSIS' AND biopsy_status IN ('INCONCLUSIVE', 'NOT_FEASIBLE') "
         "AND positive_pet_would_change_to_curative_resection = 'YES'", 3,
         "Allow PET/PET-CT exception; document direct surgical impact requirement"),
    Rule("R04", 80, "MODIFIER", "CAUTION", "suspected_tumor_type = 'NEUROENDOCRINE'", 1,
         "Attach warning: FDG-negative disease possible; negative PET does not exclude disease"),
    Rule("R05", 70, "DECISION", "RECOMMENDED", "clinical_scenario = 'PREOP_STAGING' AND surgical_candidacy = 'YES'", 2,
         "Recommend PET/PET-CT for staging; focus on distant metastasis detection and surgical plan changes"),
    Rule("R06", 65, "DECISION", "NOT_RECOMMENDED", "clinical_scenario = 'PREOP_STAGING' AND surgical_candidacy = 'NO'", 2,
         "Do not recommend routine PET under this guideline context"),
    Rule("R07", 60, "DECISION", "NO_RECOMMENDATION", "clinical_scenario = 'TREATMENT_RESPONSE'", 1,
         "State evidence insufficient for or against PET in treatment response assessment"),
    Rule("R08", 58, "DECISION", "NOT_RECOMMENDED",
         "clinical_scenario = 'TREATMENT_RESPONSE' AND post_resection_status = 'INCOMPLETE_RESECTION'", 2,
         "State PET cannot be recommended after incomplete resection"),
    Rule("R09", 50, "DECISION", "NOT_RECOMMENDED",
         "clinical_scenario IN ('RECURRENCE', 'RESTAGING') AND care_context = 'ROUTINE'", 2,
         "Do not recommend routine PET for recurrence/restaging"),
    Rule("R10", 48, "DECISION", "CONDITIONAL_CONSIDER",
         "clinical_scenario IN ('RECURRENCE', 'RESTAGING') AND care_context = 'CLINICAL_TRIAL'", 2,
         "Allow PET only in trial protocol; require trial documentation"),
    Rule("R11", 45, "DECISION", "NO_RECOMMENDATION", "clinical_scenario = 'SOLITARY_METASTASIS_AT_RECURRENCE'", 1,
         "Report no direct evidence; no recommendation possible"),
]
# ---------------------------------------------------------------------------


#: Schema of a decision table file (``read_table_csv``).
TABLE_SCHEMA = "rule_id string, priority int, clinical_scenario string, activation_condition string, recommendation string, execute_actions string, evidence_strength string, notes string"
#: A decision table is compiled into columns: it must be of a person's making.
MAX_TABLE_RULES = 1000
_KINDS = {"INSUFFICIENT_DATA": "GATE", "CAUTION": "MODIFIER", "APPEND_QUALIFIER": "WRAPPER", "APPEND_SAFETY": "WRAPPER"}


def condition_sql(text: str) -> str:
    """A table's condition as an SQL expression: ``field=VALUE`` and ``field
    IN (A, B)`` joined by AND, OR and brackets; ``always=true`` is true."""
    if text.strip().lower() == "always=true":
        return "true"
    quoted = re.sub(r"\bIN\s*\(([^)]*)\)", lambda m: "IN (" + ", ".join(f"'{v.strip()}'" for v in m[1].split(",")) + ")", text)
    return re.sub(r"(\w+)\s*=\s*(\w+)", r"\1 = '\2'", quoted)


def rules_from_table(rows: DataFrame) -> list[Rule]:
    """R2's rules from a decision table (``read_table_csv``): its kind follows
    from the recommendation, its specificity is the number of conditions that
    must hold together. Gates keep an empty condition: R1 decides them."""
    found = rows.limit(MAX_TABLE_RULES + 1).collect()
    if len(found) > MAX_TABLE_RULES:
        raise ValueError(f"a decision table has at most {MAX_TABLE_RULES} rules")
    out = []
    for r in found:
        kind = _KINDS.get(r["recommendation"], "DECISION")
        text = r["activation_condition"] or ""
        out.append(Rule(
            r["rule_id"], int(r["priority"]), kind, r["recommendation"], "" if kind == "GATE" else condition_sql(text), len(re.split(r"\s+AND\s+", text)),
            r["execute_actions"], r["evidence_strength"] or "", r["notes"] or "",
        ))
    return sorted(out, key=lambda r: (-r.priority, r.rule_id))


def missing_required(fields=REQUIRED_FIELDS) -> Column:
    """Names of absent (null) required inputs, in field order (Q10: the
    value UNKNOWN is not missing)."""
    return F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def _rule_struct(r: Rule) -> Column:
    return F.struct(
        F.lit(r.rule_id).alias("rule_id"),
        F.lit(r.priority).alias("priority"),
        F.lit(r.specificity).alias("specificity"),
        F.lit(r.recommendation).alias("recommendation"),
        F.lit(r.execute).alias("execute"),
        F.coalesce(F.expr(r.condition), F.lit(False)).alias("fired"),
    )


def fire_rules(rules=PET_RULES, kind: str = "DECISION") -> Column:
    """R2: fired rules of one kind, in descending priority."""
    chosen = sorted([r for r in rules if r.kind == kind], key=lambda r: (-r.priority, r.rule_id))
    return F.filter(F.array(*[_rule_struct(r) for r in chosen]), lambda x: x["fired"])


def _winner(fired: Column, policy: str) -> Column:
    def key(x):
        # rule id ascending as the last tie-break: negate its number
        num = F.regexp_extract(x["rule_id"], r"(\d+)", 1).cast("int")
        if policy == "priority":
            return F.struct(x["priority"].alias("a"), x["specificity"].alias("b"), (-num).alias("c"), x.alias("r"))
        if policy == "specificity":
            return F.struct(x["specificity"].alias("a"), x["priority"].alias("b"), (-num).alias("c"), x.alias("r"))
        raise ValueError("policy must be 'priority' or 'specificity'")

    return F.array_max(F.transform(fired, key))["r"]


def decide(patients: DataFrame, rules=PET_RULES, policy: str = "specificity") -> DataFrame:
    """R1-R4 for every patient row.

    Gate: any missing required field gives INSUFFICIENT_DATA, activated
    R01 + wrappers, UNDETERMINED. Otherwise the winning decision rule sets
    the class (NO_RECOMMENDATION when none fires); the modifier is appended,
    then both wrappers. ``policy`` settles Q9: ``specificity`` (default,
    so the exceptions R03 / R08 override R02 / R07) or ``priority``.
    """
    # Staged as columns so the rule arrays are evaluated once per row (an
    # array expression referenced from several CASE branches is otherwise
    # re-evaluated per branch).
    patients = patients.withColumns(
        {
            "_missing": missing_required(),
            "_decisions": fire_rules(rules, "DECISION"),
            "_modifiers": fire_rules(rules, "MODIFIER"),
        }
    ).withColumn("_win", _winner(F.col("_decisions"), policy))
    missing, decisions, modifiers, win = F.col("_missing"), F.col("_decisions"), F.col("_modifiers"), F.col("_win")
    gated = F.size(missing) > 0
    wrappers = F.array(*[F.lit(r) for r in WRAPPER_RULE_IDS])
    activated = F.when(gated, F.concat(F.array(F.lit(GATE_RULE)), wrappers)).otherwise(
        F.concat(F.transform(decisions, lambda x: x["rule_id"]), F.transform(modifiers, lambda x: x["rule_id"]), wrappers)
    )
    mod_texts = F.transform(modifiers, lambda x: F.lit(MODIFIER_TEXT))
    qualifiers = F.when(gated, F.array(F.lit(EVIDENCE_NOTE), F.lit(SAFETY_NOTE))).otherwise(
        F.concat(mod_texts, F.array(F.lit(EVIDENCE_NOTE), F.lit(SAFETY_NOTE)))
    )
    rec = F.when(gated, F.lit("INSUFFICIENT_DATA")).when(F.size(decisions) == 0, F.lit("NO_RECOMMENDATION")).otherwise(
        win["recommendation"]
    )
    rationale = F.when(gated, F.concat(F.lit("Request missing fields: "), F.array_join(missing, ", "))).when(
        F.size(decisions) == 0, F.lit("No decision rule fired")
    ).otherwise(win["execute"])
    keep = [c for c in patients.columns if not c.startswith("_")]
    return patients.select(
        *keep,
        rec.alias("recommendation_class"),
        F.when(gated | (F.size(decisions) == 0), F.lit(None).cast("string")).otherwise(win["rule_id"]).alias("winning_rule"),
        activated.alias("activated_rules"),
        rationale.alias("rationale"),
        qualifiers.alias("qualifiers"),
        F.lit(SAFETY_NOTE).alias("safety_notice"),
        F.when(gated, F.lit("UNDETERMINED")).otherwise(F.lit("CONCORDANT")).alias("guideline_concordance"),
        missing.alias("missing_fields"),
    )


def audit_log(decided: DataFrame, key: str = "patient_id", policy_version: str = POLICY_VERSION) -> DataFrame:
    """One audit row per decision: input snapshot, fired rules, result,
    timestamp and policy version (append it with ``sinks.append_results``)."""
    inputs = [c for c in REQUIRED_FIELDS + OPTIONAL_FIELDS if c in decided.columns]
    return decided.select(
        key,
        F.to_json(F.struct(*inputs)).alias("input_snapshot"),
        "activated_rules",
        "recommendation_class",
        F.current_timestamp().alias("logged_at"),
        F.lit(policy_version).alias("policy_version"),
    )
