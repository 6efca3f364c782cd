"""Decision-table and validation bindings.

Patients come from ``orders``: order priority = clinical scenario, order
status = surgical candidacy, md5 digits for the other inputs (with nulls so
the input gate fires). Near-miss validation runs over examples built from
every line of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import (
    EVIDENCE_NOTE,
    MODIFIER_TEXT,
    PET_RULES,
    REQUIRED_FIELDS,
    SAFETY_NOTE,
    decide,
)
from ..operators.rules import HINTING_ACTION_PHRASES, validate_near_misses
from ..session import table
from .common import hex_digit, key_text, sql_hex_digit

SCENARIO_BY_PRIORITY = [("1-URGENT", "INITIAL_DIAGNOSIS"), ("2-HIGH", "PREOP_STAGING"), ("3-MEDIUM", "TREATMENT_RESPONSE"),
                        ("4-NOT SPECIFIED", "RECURRENCE")]
LOW_SCENARIOS = ["RESTAGING", "SOLITARY_METASTASIS_AT_RECURRENCE"]
CANDIDACY_BY_STATUS = [("F", "YES"), ("O", "NO"), ("P", "UNKNOWN")]
BIOPSY = ["DIAGNOSTIC", "INCONCLUSIVE", "NOT_FEASIBLE", "NOT_DONE", "UNKNOWN"]
YES_NO = ["YES", "NO", "UNKNOWN"]
TUMOR = ["ADENOCARCINOMA", "NEUROENDOCRINE", "OTHER", "UNKNOWN"]
RESECTION = ["COMPLETE_RESECTION", "INCOMPLETE_RESECTION", "NONE", "UNKNOWN"]
CARE = ["ROUTINE", "CLINICAL_TRIAL", "UNKNOWN"]


def _pick(options, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx + 1)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = key_text(F.col("o_orderkey"), "pet")
    h = lambda i: hex_digit(k, i)
    scen = F.lit(None).cast("string")
    for p, s in reversed(SCENARIO_BY_PRIORITY):
        scen = F.when(F.col("o_orderpriority") == p, F.lit(s)).otherwise(scen)
    scen = F.when(F.col("o_orderpriority") == "5-LOW", _pick(LOW_SCENARIOS, h(9) % 2)).otherwise(scen)
    cand = F.lit(None).cast("string")
    for s, c in reversed(CANDIDACY_BY_STATUS):
        cand = F.when(F.col("o_orderstatus") == s, F.lit(c)).otherwise(cand)
    return o.select(
        F.col("o_orderkey").alias("patient_id"),
        F.when(h(1) == 0, F.lit(None).cast("string")).otherwise(scen).alias("clinical_scenario"),
        F.when(h(2) == 0, F.lit(None).cast("string")).otherwise(cand).alias("surgical_candidacy"),
        F.when(h(3) == 15, F.lit(None).cast("string")).otherwise(_pick(BIOPSY, h(3) % 5)).alias("biopsy_status"),
        F.when(h(4) == 15, F.lit(None).cast("string")).otherwise(_pick(YES_NO, h(4) % 3)).alias("recurrence_status"),
        F.when(h(5) % 4 == 3, F.lit(None).cast("string")).otherwise(_pick(YES_NO, h(5) % 4)).alias(
            "positive_pet_would_change_to_curative_resection"
        ),
        F.when(h(6) % 5 == 4, F.lit(None).cast("string")).otherwise(_pick(TUMOR, h(6) % 5)).alias("suspected_tumor_type"),
        _pick(RESECTION, h(7) % 4).alias("post_resection_status"),
        _pick(CARE, h(8) % 3).alias("care_context"),
    )


def _fire(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    d = decide(patients(spark, sf_dir), policy=policy)
    return d.select(
        "patient_id",
        "recommendation_class",
        "winning_rule",
        F.array_join("activated_rules", ",").alias("activated_rules"),
        F.array_join("missing_fields", ",").alias("missing_fields"),
        F.size("qualifiers").alias("n_qualifiers"),
        "rationale",
        "guideline_concordance",
    )


def fire_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fire(spark, sf_dir, "specificity")


def fire_rules_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fire(spark, sf_dir, "priority")


def validate_near_miss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 over examples built from document lines; rules R001 / R002 exist."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    doc = F.col("doc_id")

    def example(line, i):
        k = key_text(doc, "nm", i)
        likely = F.when(hex_digit(k, 1) < 3, F.array(F.concat(F.lit("Act as if "), line), line)).otherwise(
            F.split(line, ", ")
        )
        return F.struct(
            F.when(hex_digit(k, 2) == 0, F.lit("  ")).otherwise(line).alias("patient_vignette"),
            F.array(F.lit("R001"), F.format_string("R%03d", (hex_digit(k, 3) % 4) + 1)).alias("invalidated_rule_ids"),
            F.array(F.lit("R002"), F.lit("R009")).alias("triggered_rule_ids"),
            F.lit(" similar ").alias("deceptive_similarity"),
            likely.alias("likely_but_incorrect_actions"),
            F.split(line, r"\. ").alias("recommended_actions"),
            F.lit("").alias("corrected_assessment"),
            F.lit("").alias("rationale"),
            F.lit("CONCORDANT").alias("true_guideline_concordance"),
            F.element_at(F.array(*[F.lit(x) for x in ["easy", " HARD ", "Medium", "extreme"]]), (hex_digit(k, 4) % 4) + 1).alias("difficulty"),
        )

    rules = F.array(
        F.struct(F.lit("R001").alias("rule_id"), F.lit(80).alias("priority")),
        F.struct(F.lit("R002").alias("rule_id"), F.lit(70).alias("priority")),
    )
    ex = d.select(doc, F.transform(F.split("text", "\n"), example).alias("examples"))
    v = ex.select(doc, F.posexplode(validate_near_misses(F.col("examples"), rules)).alias("pos", "e"))
    return v.select(
        "doc_id",
        "pos",
        F.col("e.patient_vignette").alias("patient_vignette"),
        F.array_join("e.invalidated_rule_ids", ",").alias("invalidated_rule_ids"),
        F.array_join("e.triggered_rule_ids", ",").alias("triggered_rule_ids"),
        F.array_join("e.likely_but_incorrect_actions", " | ").alias("likely_but_incorrect_actions"),
        F.size("e.recommended_actions").alias("n_recommended"),
        F.col("e.difficulty").alias("difficulty"),
        F.col("e.true_guideline_concordance").alias("true_guideline_concordance"),
    )


QUERIES = {
    "fire_rules": fire_rules,
    "fire_rules_priority": fire_rules_priority,
    "validate_near_misses": validate_near_miss_table,
}


# -- DuckDB oracles -------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_pick(options, idx: str) -> str:
    return "[" + ", ".join(_q(o) for o in options) + f"][{idx} + 1]"


def _patients_sql() -> str:
    k = "CAST(o_orderkey AS VARCHAR) || ':pet'"
    h = lambda i: sql_hex_digit(k, i)
    scen = "CASE " + " ".join(f"WHEN o_orderpriority = {_q(p)} THEN {_q(s)}" for p, s in SCENARIO_BY_PRIORITY)
    scen += f" WHEN o_orderpriority = '5-LOW' THEN {_sql_pick(LOW_SCENARIOS, h(9) + ' % 2')} END"
    cand = "CASE " + " ".join(f"WHEN o_orderstatus = {_q(s)} THEN {_q(c)}" for s, c in CANDIDACY_BY_STATUS) + " END"
    return f"""
SELECT o_orderkey AS patient_id,
  CASE WHEN {h(1)} = 0 THEN NULL ELSE {scen} END AS clinical_scenario,
  CASE WHEN {h(2)} = 0 THEN NULL ELSE {cand} END AS surgical_candidacy,
  CASE WHEN {h(3)} = 15 THEN NULL ELSE {_sql_pick(BIOPSY, h(3) + ' % 5')} END AS biopsy_status,
  CASE WHEN {h(4)} = 15 THEN NULL ELSE {_sql_pick(YES_NO, h(4) + ' % 3')} END AS recurrence_status,
  CASE WHEN {h(5)} % 4 = 3 THEN NULL ELSE {_sql_pick(YES_NO, h(5) + ' % 4')} END AS positive_pet_would_change_to_curative_resection,
  CASE WHEN {h(6)} % 5 = 4 THEN NULL ELSE {_sql_pick(TUMOR, h(6) + ' % 5')} END AS suspected_tumor_type,
  {_sql_pick(RESECTION, h(7) + ' % 4')} AS post_resection_status,
  {_sql_pick(CARE, h(8) + ' % 3')} AS care_context
FROM orders
"""


def _fire_sql(policy: str) -> str:
    decisions = sorted([r for r in PET_RULES if r.kind == "DECISION"], key=lambda r: (-r.priority, r.rule_id))
    mods = [r for r in PET_RULES if r.kind == "MODIFIER"]
    if policy == "specificity":
        order = sorted(decisions, key=lambda r: (-r.specificity, -r.priority, r.rule_id))
    else:
        order = sorted(decisions, key=lambda r: (-r.priority, -r.specificity, r.rule_id))
    cond = lambda r: f"coalesce(({r.condition}), false)"
    win = "CASE " + " ".join(f"WHEN {cond(r)} THEN {_q(r.rule_id)}" for r in order) + " END"
    rec = "CASE " + " ".join(f"WHEN {cond(r)} THEN {_q(r.recommendation)}" for r in order) + " ELSE 'NO_RECOMMENDATION' END"
    exe = "CASE " + " ".join(f"WHEN {cond(r)} THEN {_q(r.execute)}" for r in order) + " ELSE 'No decision rule fired' END"
    fired = "concat_ws(',', " + ", ".join(f"CASE WHEN {cond(r)} THEN {_q(r.rule_id)} END" for r in decisions + mods) + ", 'R12', 'R13')"
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN {_q(f)} END" for f in REQUIRED_FIELDS) + ")"
    nmod = " + ".join(f"(CASE WHEN {cond(r)} THEN 1 ELSE 0 END)" for r in mods)
    _ = (EVIDENCE_NOTE, SAFETY_NOTE, MODIFIER_TEXT)
    return f"""
WITH p AS ({_patients_sql()}), m AS (SELECT *, {missing} AS missing_fields FROM p)
SELECT patient_id,
  CASE WHEN missing_fields <> '' THEN 'INSUFFICIENT_DATA' ELSE {rec} END AS recommendation_class,
  CASE WHEN missing_fields <> '' THEN NULL ELSE {win} END AS winning_rule,
  CASE WHEN missing_fields <> '' THEN 'R01,R12,R13' ELSE {fired} END AS activated_rules,
  missing_fields,
  CAST(CASE WHEN missing_fields <> '' THEN 2 ELSE 2 + {nmod} END AS INTEGER) AS n_qualifiers,
  CASE WHEN missing_fields <> '' THEN 'Request missing fields: ' || replace(missing_fields, ',', ', ') ELSE {exe} END AS rationale,
  CASE WHEN missing_fields <> '' THEN 'UNDETERMINED' ELSE 'CONCORDANT' END AS guideline_concordance
FROM m
"""


def _validate_sql() -> str:
    k = "CAST(doc_id AS VARCHAR) || ':nm:' || CAST(i AS VARCHAR)"
    h = lambda n: sql_hex_digit(k, n)
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    hint = " OR ".join(f"contains(lower(a), {_q(p)})" for p in HINTING_ACTION_PHRASES)
    likely_raw = f"(CASE WHEN {h(1)} < 3 THEN ['Act as if ' || line, line] ELSE string_split(line, ', ') END)"
    likely = f"list_filter(list_filter(list_transform({likely_raw}, lambda a: {strip('a')}), lambda a: a <> ''), lambda a: NOT ({hint}))"
    inval = f"list_filter(['R001', 'R' || lpad(CAST({h(3)} % 4 + 1 AS VARCHAR), 3, '0')], lambda x: list_contains(['R001', 'R002'], x))"
    diff_raw = f"lower({strip(_sql_pick(['easy', ' HARD ', 'Medium', 'extreme'], h(4) + ' % 4'))})"
    recs = f"len(list_filter(list_transform(string_split_regex(line, '\\. '), lambda a: {strip('a')}), lambda a: a <> ''))"
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents
), e AS (
  SELECT doc_id, i, {strip(f"CASE WHEN {h(2)} = 0 THEN '  ' ELSE line END")} AS v, {inval} AS inv, {likely} AS lk,
    {recs} AS n_recommended, {diff_raw} AS d
  FROM l
), kept AS (SELECT * FROM e WHERE v <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, v AS patient_vignette,
  array_to_string(inv, ',') AS invalidated_rule_ids, 'R002' AS triggered_rule_ids,
  array_to_string(lk, ' | ') AS likely_but_incorrect_actions, CAST(n_recommended AS INTEGER) AS n_recommended,
  CASE WHEN d IN ('easy', 'medium', 'hard') THEN d ELSE 'medium' END AS difficulty,
  'DISCORDANT' AS true_guideline_concordance
FROM kept
"""


def oracles() -> dict[str, str]:
    return {
        "fire_rules": _fire_sql("specificity"),
        "fire_rules_priority": _fire_sql("priority"),
        "validate_near_misses": _validate_sql(),
    }
