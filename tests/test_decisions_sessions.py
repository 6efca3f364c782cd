import json

from evalsmith.operators.decisions import audit_log, decide
from evalsmith.operators.sessions import optimizer_runs, sessionize_steps
from evalsmith.sources.readers import read_log

PATIENT = ("patient_id string, clinical_scenario string, surgical_candidacy string, biopsy_status string, "
           "recurrence_status string, positive_pet_would_change_to_curative_resection string, "
           "suspected_tumor_type string, post_resection_status string, care_context string")


def _p(pid, scen="INITIAL_DIAGNOSIS", cand="YES", biopsy="DIAGNOSTIC", rec="NO", pet=None, tumor=None, res=None, care=None):
    return (pid, scen, cand, biopsy, rec, pet, tumor, res, care)


def test_decision_table_truth(spark):
    rows = [
        _p("gate", scen=None),
        _p("unknown_ok", cand="UNKNOWN"),
        _p("r02"),
        _p("r02_r03", biopsy="INCONCLUSIVE", pet="YES"),
        _p("r05_r04", scen="PREOP_STAGING", tumor="NEUROENDOCRINE"),
        _p("r07_r08", scen="TREATMENT_RESPONSE", res="INCOMPLETE_RESECTION"),
        _p("none", scen="RECURRENCE", care="UNKNOWN"),
        _p("r10", scen="RESTAGING", care="CLINICAL_TRIAL"),
    ]
    df = spark.createDataFrame(rows, PATIENT)
    spec = {r["patient_id"]: r for r in decide(df).collect()}
    prio = {r["patient_id"]: r for r in decide(df, policy="priority").collect()}
    g = spec["gate"]
    assert g["recommendation_class"] == "INSUFFICIENT_DATA" and g["activated_rules"] == ["R01", "R12", "R13"]
    assert g["missing_fields"] == ["clinical_scenario"] and g["guideline_concordance"] == "UNDETERMINED"
    assert spec["unknown_ok"]["recommendation_class"] == "NOT_RECOMMENDED"  # Q10: UNKNOWN is not missing
    assert spec["r02_r03"]["winning_rule"] == "R03" and prio["r02_r03"]["winning_rule"] == "R02"
    assert spec["r07_r08"]["winning_rule"] == "R08" and prio["r07_r08"]["winning_rule"] == "R07"
    r = spec["r05_r04"]
    assert r["recommendation_class"] == "RECOMMENDED" and r["activated_rules"] == ["R05", "R04", "R12", "R13"]
    assert len(r["qualifiers"]) == 3
    assert spec["none"]["recommendation_class"] == "NO_RECOMMENDATION" and spec["none"]["activated_rules"] == ["R12", "R13"]
    assert spec["r10"]["recommendation_class"] == "CONDITIONAL_CONSIDER"
    a = audit_log(decide(df)).first()
    assert a["policy_version"] == "1.0.0" and json.loads(a["input_snapshot"])


def _write_log(path, lines):
    with open(path, "w") as f:
        for line in lines:
            f.write((json.dumps(line) if isinstance(line, dict) else line) + "\n")


def test_optimizer_log_sessionization(spark, tmpdir_path):
    S, C = "LLMCall function forward", "TextualGradientDescent updated text"
    P = "TextualGradientDescent prompt for update"
    lines = [
        {"msg": C, "parameter.value": "orphan close"},              # before the first start: ignored
        "",                                                          # blank
        "{not json",                                                 # malformed
        "[1, 2]",                                                    # JSON but not an object (Q19)
        {"msg": S, "text": "open then abandoned"},                   # second start before a close
        {"msg": S, "text": "sys\nQuery: #Question#: what?\n\n#Hallucinated Answer#: a\nResponse: r"},
        {"msg": "", "message": P, "prompt": "<VARIABLE> v1 </VARIABLE>"},  # msg empty, message set
        {"msg": P, "prompt": "p-last"},
        {"msg": C, "parameter.value": " u1 "},
        {"msg": P, "prompt": "after close"},                         # outside a step
        {"msg": S, "text": "t2"}, {"msg": C, "parameter.value": "u2"},
        {"msg": S, "text": "t3"}, {"msg": C, "parameter.value": "u3"},
        {"msg": S, "text": "t4"}, {"msg": C, "parameter.value": "u4"},
        {"msg": S, "text": "t5 never closed"},
    ]
    path = f"{tmpdir_path}/log.jsonl"
    _write_log(path, lines)
    log = read_log(spark, path)
    assert log.count() == len([x for x in lines if isinstance(x, dict)])
    runs = sorted(optimizer_runs(log, 3, include_steps=True).collect(), key=lambda r: r["optimization_index"])
    assert [r["step_count"] for r in runs] == [3, 1]
    assert [r["is_partial"] for r in runs] == [False, True]
    first = runs[0]
    assert first["initial_text"] == "#Question#: what?\n\n#Hallucinated Answer#: a"
    assert first["question"] == "what?"
    assert first["final_updated_text"] == "u3"
    assert first["reconstructed_follow_up_prompt"].endswith("Previous attempt improved by TextGrad: u3")
    assert first["steps"][0]["optimizer_prompt"] == "p-last" and first["steps"][0]["updated_text"] == "u1"
    assert runs[1]["final_updated_text"] == "u4"


def test_sessionize_chunked_equals_single_chunk(spark):
    rows = []
    for u in range(3):
        for i in range(60):
            t = ["signup", "click", "view", "purchase", "error"][(i * 7 + u) % 5]
            rows.append((u, i * 3 + u, t, f"p{i}"))
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, payload string")
    args = ("user_id", "event_id", "event_type", "payload", "signup", "purchase", {"click": "backward_gradient"}, 2)
    a = {tuple(r) for r in sessionize_steps(df, *args, chunk_width=1 << 20).collect()}
    b = {tuple(r) for r in sessionize_steps(df, *args, chunk_width=7).collect()}
    assert a == b and len(a) > 0


def test_rules_from_a_table_file(spark, tmpdir_path):
    """The compiled table decides as the built-in one; N/A stays text."""
    from dataclasses import replace

    from evalsmith.operators.decisions import PET_RULES, TABLE_SCHEMA, condition_sql, decide, rules_from_table
    from evalsmith.plans.decisions import patients
    from evalsmith.sources.readers import read_table_csv

    assert condition_sql("a=X AND (b=Y OR b=Z) AND c IN (P, Q)") == "a = 'X' AND (b = 'Y' OR b = 'Z') AND c IN ('P', 'Q')"
    lines = ["rule_id,priority,clinical_scenario,activation_condition,recommendation,execute_actions,evidence_strength,notes"]
    lines.append('R01,100,ANY,"Missing one or more required fields",INSUFFICIENT_DATA,"Request missing fields",N/A,Input gate')
    for r in PET_RULES:
        text = r.condition.replace(" = '", "=").replace("'", "")
        lines.append(f'{r.rule_id},{r.priority},S,"{text}",{r.recommendation},"{r.execute}",LOW,note')
    lines.append('R12,20,G,always=true,APPEND_QUALIFIER,"Append",N/A,all')
    with open(f"{tmpdir_path}/table.csv", "w") as f:
        f.write("\n".join(lines))
    rules = rules_from_table(read_table_csv(spark, f"{tmpdir_path}/table.csv", TABLE_SCHEMA))
    assert [(r.rule_id, r.kind, r.evidence_strength) for r in rules if r.kind in ("GATE", "WRAPPER")] == [("R01", "GATE", "N/A"), ("R12", "WRAPPER", "N/A")]
    decided = [r for r in rules if r.kind in ("DECISION", "MODIFIER")]
    assert [replace(r, evidence_strength="", notes="") for r in decided] == PET_RULES
    p = patients(spark, "/root/testdata/sf0.001")
    assert decide(p, rules).exceptAll(decide(p)).count() == 0
