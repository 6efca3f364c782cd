from pyspark.sql import functions as F

from evalsmith.operators.cases import (
    action_text_columns,
    actionable_rules,
    all_cases,
    concordant_cases,
    guideline_header,
    near_miss_cases,
    record_status,
    reference_cases,
    require_columns,
    select_index_range,
)
from evalsmith.operators.rules import (
    cited_rules_array,
    number_rules_array,
    render_rules,
    top_rules,
    top_rules_array,
    validate_near_misses,
)

RULE = "struct<rule_id:string,scenario:string,priority:int,activation_condition:string,recommendation_class:string,execute:string,source_statement:string>"
CASE = "struct<patient_vignette:string,triggered_rule_ids:array<string>,recommended_actions:array<string>,rationale:string>"
EX = ("struct<patient_vignette:string,invalidated_rule_ids:array<string>,triggered_rule_ids:array<string>,"
      "deceptive_similarity:string,likely_but_incorrect_actions:array<string>,recommended_actions:array<string>,"
      "corrected_assessment:string,rationale:string,true_guideline_concordance:string,difficulty:string>")
SCHEMA = (f"guideline struct<record_index:int,id:string,source:string,title:string,extraction_method:string>, "
          f"selected_rules array<{RULE}>, source_case {CASE}, generated_case {CASE}, challenging_examples array<{EX}>")


def ex(v, likely=("x",), rec=("r1",), diff="medium"):
    return (v, ["R1"], ["R2"], "", list(likely) if likely is not None else None, list(rec) if rec is not None else None, "", "", "DISCORDANT", diff)


def records(spark):
    rules = [("R1", "GENERAL", 80, None, "RECOMMENDED", "do", "s"), ("R2", None, None, "c", None, None, None)]
    rows = [
        ((1, "g1", "src", "T", "llm"), rules, ("vig one", ["R1"], ["a", "A.", "b"], ""), None,
         [ex("e0"), ex("  "), ex("e2", diff=" HARD "), ex("e3", likely=[]), ex("e4", rec=[], diff=None)]),
        # blank source case with good examples (Q7)
        ((2, "g2", "src", "T2", "llm"), [], ("  ", [], ["a"], ""), None, [ex("f0")]),
        # null record index
        ((None, None, None, None, None), [], ("v3", [], ["z"], ""), ("gen3", [], ["q", " "], ""), []),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_concordant_and_near_miss(spark):
    r = records(spark)
    conc = {x["case_id"]: x for x in concordant_cases(r, "source_case").collect()}
    assert set(conc) == {"1_source", "unknown_source"}
    nm = {x["case_id"]: x for x in near_miss_cases(r).collect()}
    # positions count skipped elements; e3 has no likely actions
    assert set(nm) == {"1_adv_0", "1_adv_2", "1_adv_4", "2_adv_0"}
    assert nm["1_adv_2"]["difficulty"] == "hard" and nm["1_adv_4"]["difficulty"] == "medium"
    assert nm["1_adv_0"]["label"] == 1 and conc["1_source"]["label"] == 0
    allc = action_text_columns(all_cases(concordant_cases(r, "source_case"), near_miss_cases(r)))
    row = [x for x in allc.collect() if x["case_id"] == "1_source"][0]
    assert row["proposed_actions_text"] == "- a\n- A.\n- b" and row["reference_rule_ids_text"] == "R1"
    assert "Rule ID: R1" in row["rules_text"] and "Scenario: UNKNOWN" in row["rules_text"]


def test_reference_cases_q7(spark):
    r = records(spark)
    got = {x["case_id"]: x for x in reference_cases(r).collect()}
    # record 2's base case is blank, so its example is dropped too (Q7)
    assert "2_challenging_example_0" not in got
    assert got["1_source_case"]["reference_actions"] == ["a", "b"]
    # example with empty cleaned actions is kept
    assert got["1_challenging_example_4"]["reference_actions"] == []
    assert got["unknown_generated_case"]["reference_actions"] == ["q"]
    kept = {x["case_id"] for x in reference_cases(r, keep_orphan_examples=True).collect()}
    assert "2_challenging_example_0" in kept


def test_require_and_range(spark):
    r = records(spark)
    try:
        require_columns(r, ["guideline", "nope"])
        raise AssertionError("expected error")
    except ValueError as e:
        assert "nope" in str(e)
    assert select_index_range(r, 1, 1).count() == 1


def test_rule_arrays(spark):
    rules = [("R2", "S", 50, None, "RECOMMENDED", None, None), ("R1", "S", 50, None, "APPEND_SAFETY", None, None),
             ("R3", "S", 90, None, None, None, None)]
    df = spark.createDataFrame([(rules, ["R1", "R9", "R1"])], f"rules array<{RULE}>, ids array<string>")
    top = df.select(top_rules_array("rules", 2)).first()[0]
    assert [x["rule_id"] for x in top] == ["R3", "R1"]
    act = df.select(actionable_rules("rules")).first()[0]
    assert [x["rule_id"] for x in act] == ["R2", "R3"]
    assert df.select(cited_rules_array("ids", "rules")).first()[0] == ["R1", "R1"]
    text = df.select(render_rules("rules")).first()[0]
    assert text.count("Rule ID:") == 3 and "\n\n" in text and "Activation Condition: \n" in text


def test_number_rules_array(spark):
    raw = [
        ("x", "initial_diagnosis", None, "", "recommended", "", "it is recommended"),
        ("x", "bogus", None, "c", "??", "e", "may be considered in staging"),
        ("x", None, None, "c", "??", "e", "nothing"),  # class cannot be inferred: dropped
    ]
    df = spark.createDataFrame([(raw,)], f"rules array<{RULE}>")
    out = df.select(number_rules_array("rules")).first()[0]
    assert [x["rule_id"] for x in out] == ["R001", "R002", "R003", "R004"]
    assert [x["priority"] for x in out] == [70, 60, 20, 10]
    assert out[0]["activation_condition"] == "scenario=INITIAL_DIAGNOSIS"
    assert out[0]["execute"].startswith("Recommend use in this scenario. Basis: ")
    assert out[1]["scenario"] == "PREOP_STAGING" and out[1]["recommendation_class"] == "CONDITIONAL_CONSIDER"
    assert out[2]["recommendation_class"] == "APPEND_QUALIFIER"


def test_top_rules_rows(spark):
    rows = [("b", f"P{i:02d}", i % 3) for i in range(10)] + [("c", "P99", 1)]
    df = spark.createDataFrame(rows, "record string, rule_id string, priority int")
    got = top_rules(df, "record", k=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["record"], []).append((r["rank"], r["rule_id"]))
    assert sorted(by["b"]) == [(1, "P02"), (2, "P05")] and by["c"] == [(1, "P99")]


def test_validate_near_misses(spark):
    exs = [ex(" v ", likely=["Act as if x", " y ", ""], diff="Extreme"), ex("", likely=["z"])]
    rules = [("R1", None, None, None, None, None, None)]
    df = spark.createDataFrame([(exs, rules)], f"e array<{EX}>, rules array<{RULE}>")
    out = df.select(validate_near_misses("e", "rules")).first()[0]
    assert len(out) == 1
    o = out[0]
    assert o["patient_vignette"] == "v" and o["likely_but_incorrect_actions"] == ["y"]
    assert o["invalidated_rule_ids"] == ["R1"] and o["triggered_rule_ids"] == []
    assert o["difficulty"] == "medium" and o["true_guideline_concordance"] == "DISCORDANT"


def test_header_and_status(spark):
    df = spark.createDataFrame([((1, None, " ", "", None),)], "g struct<record_index:int,id:string,source:string,title:string,extraction_method:string>")
    h = df.select(guideline_header("g")).first()[0]
    assert h["title"] == "Untitled guideline" and h["id"] == "unknown" and h["source"] == "unknown"
    s = spark.createDataFrame([(0, True, 0), (2, False, 0), (2, True, 1), (2, True, 0)], "a int, s boolean, n int")
    assert [r[0] for r in s.select(record_status("a", "s", "n")).collect()] == [
        "skipped_no_actionable_rules", "skipped_missing_source_case", "generated", "empty_generation"]
    assert F is not None


def test_number_rules_rows_chunked(spark):
    from evalsmith.operators.rules import number_rules

    classes = ["recommended", "NOT_RECOMMENDED", " conditional_consider ", "unknown", None]
    rows = [(f"b{i % 2}", i * 7 + 1, "GENERAL", None, "", classes[i % 5], None, "it is recommended" if i % 3 else "")
            for i in range(40)]
    raw = spark.createDataFrame(rows, "record string, pos long, scenario string, priority int, activation_condition string, "
                                      "recommendation_class string, execute string, source_statement string")
    a = sorted(tuple(r) for r in number_rules(raw, "record", "pos").collect())
    b = sorted(tuple(r) for r in number_rules(raw, "record", "pos", rows_per_task=5).collect())
    assert a == b
    by = {}
    for r in number_rules(raw, "record", "pos").collect():
        by.setdefault(r["record"], []).append((r["rule_id"], r["priority"]))
    for rec, lst in by.items():
        lst.sort()
        assert [x[0] for x in lst] == [f"R{i:03d}" for i in range(1, len(lst) + 1)]
        prios = [x[1] for x in lst]
        assert prios == sorted(prios, reverse=True) and prios[-2:] == [20, 10]
