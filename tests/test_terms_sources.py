import json
import os

import pytest
from pyspark.sql import functions as F

from evalsmith.operators.terms import (
    category_by_count,
    category_by_weight,
    descriptor_categories,
    distinct_sorted_terms,
    explode_terms,
    extract_mesh_terms,
    lookup_category,
    term_category_map,
    term_frequency,
    value_counts,
)
from evalsmith.sources.qa import adapt_medqa, decode_legacy_knowledge, extract_guideline_text, prepare_qa_items
from evalsmith.sources.readers import read_mesh_descriptors, read_predictions, read_records, read_table_csv
from evalsmith.sources.sinks import append_results, export_csv, replace_results, with_dataset, write_records

XML = """<?xml version="1.0"?>
<DescriptorRecordSet>
<DescriptorRecord><DescriptorName><String>Risk Assessment</String></DescriptorName>
 <TreeNumberList><TreeNumber>E05.318</TreeNumber><TreeNumber>N05.715</TreeNumber><TreeNumber>N04.1</TreeNumber></TreeNumberList></DescriptorRecord>
<DescriptorRecord><DescriptorName><String>Tied</String></DescriptorName>
 <TreeNumberList><TreeNumber>C01</TreeNumber><TreeNumber>A01</TreeNumber></TreeNumberList></DescriptorRecord>
<DescriptorRecord><DescriptorName><String>NoTrees</String></DescriptorName></DescriptorRecord>
<DescriptorRecord><DescriptorName><String>Odd</String></DescriptorName>
 <TreeNumberList><TreeNumber>Q01</TreeNumber></TreeNumberList></DescriptorRecord>
<DescriptorRecord><DescriptorName><String>Tied</String></DescriptorName>
 <TreeNumberList><TreeNumber>Z01</TreeNumber></TreeNumberList></DescriptorRecord>
</DescriptorRecordSet>
"""


def test_mesh_descriptors(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "desc.xml")
    with open(p, "w") as f:
        f.write(XML)
    d = read_mesh_descriptors(spark, p)
    cats = {r["name"]: r["category"] for r in descriptor_categories(d).collect()}
    assert cats["Risk Assessment"] == "Health Care"
    assert cats["Tied"] == "Diseases"  # tie: first met; first duplicate wins
    assert cats["NoTrees"] == "Unknown Category" and cats["Odd"] == "Unknown Category"
    terms = spark.createDataFrame([("Risk Assessment",), ("Missing",)], "term string")
    got = {r["term"]: r["category"] for r in lookup_category(terms, descriptor_categories(d)).collect()}
    assert got == {"Risk Assessment": "Health Care", "Missing": "Unknown Category"}


def test_mesh_text_helpers(spark):
    ctx = "{'contexts': array(['x'], dtype=object), 'meshes': array(['Humans', 'Risk, Assessment',\n 'Aged'], dtype=object)}"
    df = spark.createDataFrame([(ctx,), ("no meshes",)], "c string")
    got = [r[0] for r in df.select(extract_mesh_terms("c")).collect()]
    assert got == ["Humans; Risk, Assessment; Aged", None]
    d2 = spark.createDataFrame([("b; a; b",), ("",)], "m string")
    assert [r[0] for r in d2.select(distinct_sorted_terms("m")).collect()] == ["a; b", ""]


def test_weights_and_winners(spark):
    rows = spark.createDataFrame([(1, "a; b; c"), (2, "a; d"), (3, "e")], "row_no long, meshes string")
    t = explode_terms(rows, ["row_no"], "meshes")
    w = term_frequency(t)
    cat = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "Y"), ("d", "Unknown Category")], "term string, category string")
    j = t.join(w, "term").join(cat, "term", "left").fillna({"category": "Unknown"})
    byw = {r["row_no"]: r["weighted_category"] for r in category_by_weight(j, ["row_no"]).collect()}
    # row 1: X = 0.5, Y = 1 + 1 -> Y; row 2: X = 0.5, Unknown Category = 1 -> Unknown Category
    assert byw[1] == "Y" and byw[2] == "Unknown Category" and byw[3] == "Unknown"
    byn = {r["row_no"]: r["frequent_category"] for r in category_by_count(j, ["row_no"]).collect()}
    assert byn[1] == "Y" and byn[2] == "X"  # Unknown Category ties X but the known one wins
    vc = value_counts(spark.createDataFrame([("a",), ("b",), ("a",)], "c string"), "c").collect()
    assert [tuple(r) for r in vc] == [("a", 2), ("b", 1)]


def test_term_category_map_last_wins(spark):
    df = spark.createDataFrame([(1, "a; b", ["X", "Y", "Z"]), (2, "a", ["W"])], "row_no long, meshes string, categories array<string>")
    got = {r["term"]: r["category"] for r in term_category_map(df).collect()}
    assert got == {"a": "W", "b": "Y"}


def test_read_records_shapes(spark, tmpdir_path):
    schema = "id long, name string"
    p1 = os.path.join(tmpdir_path, "a.json")
    with open(p1, "w") as f:
        json.dump([{"id": 1, "name": "x"}, {"id": 2, "name": "y"}], f)
    p2 = os.path.join(tmpdir_path, "b.json")
    with open(p2, "w") as f:
        json.dump({"id": 3, "name": "z"}, f)
    p3 = os.path.join(tmpdir_path, "c.jsonl")
    with open(p3, "w") as f:
        f.write('{"id": 4, "name": "w"}\n\n{"id": 5, "name": "v"}\n')
    assert read_records(spark, p1, schema).count() == 2
    assert read_records(spark, p2, schema).first()["id"] == 3
    assert read_records(spark, p3, schema).count() == 2


def test_csv_keeps_na_text(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write('rule_id,evidence_strength,notes\nR01,N/A,"line one\nline ""two"""\n')
    r = read_table_csv(spark, p, "rule_id string, evidence_strength string, notes string").first()
    assert r["evidence_strength"] == "N/A" and r["notes"] == 'line one\nline "two"'


def test_qa_sources(spark):
    df = spark.createDataFrame(
        [("q", ["k1", "k2"], "gt", "easy", "ha", "cat"), ("q2", None, "gt2", "odd", "ha2", "cat")],
        "`Question` string, `Knowledge` array<string>, `Ground Truth` string, `Difficulty Level` string, "
        "`Hallucinated Answer` string, `Category of Hallucination` string",
    )
    out = prepare_qa_items(df).collect()
    assert out[0]["knowledge"] == ["k1", "k2"] and out[1]["knowledge"] == []
    try:
        prepare_qa_items(df.drop("Question"))
        raise AssertionError("expected error")
    except ValueError as e:
        assert "question" in str(e)
    leg = spark.createDataFrame(
        [("{'contexts': ['a', \"b's\"]}",), ("{'contexts': array(['c', 'd'], dtype=object)}",), ("plain",), (None,),
         ("{'contexts': 'one'}",)], "k string"
    )
    assert [r[0] for r in leg.select(decode_legacy_knowledge("k")).collect()] == ["a\nb's", "c\nd", "plain", "", "one"]


def test_adapt_medqa(spark):
    schema = ("split string, input struct<text:string,context:string,knowledge:string,evidence:string,support:string>, "
              "context string, knowledge string, evidence string, support string, explanation string, rationale string, "
              "references array<struct<output:struct<text:string>,tags:array<string>>>, ord int")
    rows = [
        ("train", ("Q1", None, None, None, None), " ", "K1", None, None, None, None, [(("wrong",), []), (("right",), ["Correct"])], 1),
        ("train", ("Q2", "in-ctx", None, None, None), None, None, None, None, None, None, [(("first",), []), (("second",), [])], 2),
        ("train", ("Q3", None, None, None, None), None, None, None, None, None, None, [(("  ",), ["correct"]), (("x",), [])], 3),
        ("test", ("Q4", None, None, None, None), None, None, None, None, None, None, [(("y",), [])], 4),
    ]
    out = adapt_medqa(spark.createDataFrame(rows, schema), split="train", limit=10, order_col="ord").collect()
    assert [(r["question"], r["context"], r["long_answer"]) for r in out] == [("Q1", "K1", "right"), ("Q2", "in-ctx", "first")]


def test_guideline_text(spark):
    df = spark.createDataFrame(
        [("id1", " ", "a\r\nb\t\tc\n\n\n\nd", None), ("id2", "", "", ["l1", " ", "l2"]), ("id3", None, None, None)],
        "id string, guideline string, text string, recommendations array<string>",
    )
    got = [r[0] for r in df.select(extract_guideline_text(df)).collect()]
    assert got == ["a\nb c\n\nd", "l1\nl2", "id3"]


def test_predictions_and_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([("r1", "m1", '["a", "b"]', None), ("r1", "m2", "oops", "[]")],
                               "run_id string, model_name string, reference_actions string, generated_actions string")
    p = read_predictions(df, ["reference_actions", "generated_actions"])
    rows = {r["model_name"]: r for r in p.collect()}
    assert rows["m1"]["reference_actions"] == ["a", "b"] and rows["m1"]["generated_actions"] == []
    assert rows["m2"]["reference_actions"] == [] and rows["m1"]["original_reference_actions"] == ["a", "b"]
    out = os.path.join(tmpdir_path, "res")
    append_results(p, out)
    append_results(p, out)
    assert spark.read.parquet(out).count() == 4
    replace_results(p.filter(F.col("model_name") == "m1"), out)
    assert spark.read.parquet(out).count() == 3  # m1 replaced, m2 kept
    write_records(p, os.path.join(tmpdir_path, "rec"))
    back = spark.read.json(os.path.join(tmpdir_path, "rec"))
    assert "generated_actions" in back.columns
    export_csv(p, os.path.join(tmpdir_path, "csv"))
    c = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(os.path.join(tmpdir_path, "csv"))
    assert sorted(r["reference_actions"] for r in c.collect()) == ['["a","b"]', "[]"]


def test_replace_results_needs_a_partition(spark, tmpdir_path):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        replace_results(df, f"{tmpdir_path}/none")
    out = f"{tmpdir_path}/by-set"
    append_results(with_dataset(df, "/data/cases_adv.json"), out)
    append_results(with_dataset(df, "/data/advice.json"), out)
    replace_results(with_dataset(spark.createDataFrame([(2,)], "x int"), "/data/cases_adv.json"), out)
    assert sorted((r["x"], r["dataset"]) for r in spark.read.parquet(out).collect()) == [(1, "vignette"), (2, "adversarial")]


def test_guideline_text_defaults(spark):
    """An overview is no preferred field: the other texts come with it."""
    df = spark.createDataFrame([("t", "short", None, "a  b\r\nc"), ("t", "short", " ", None)], "title string, overview string, text string, notes string")
    assert [r[0] for r in df.select(extract_guideline_text(df)).collect()] == ["t\nshort\na b\nc", "t\nshort"]


def test_adapt_medqa_shapes(spark):
    schema = "input string, references array<struct<output:string,tags:string>>"
    df = spark.createDataFrame([("q1", [("a", "x"), ("b", "Correct")]), ("q2", [("", "x"), ("c", None)]), ("q3", None), (" ", [("d", "x")])], schema)
    assert sorted((r["question"], r["long_answer"]) for r in adapt_medqa(df).collect()) == [("q1", "b"), ("q2", "c")]
    with pytest.raises(ValueError):
        adapt_medqa(df.where("input = 'q3'"), require_rows=True)
    assert adapt_medqa(df.where("input = 'q3'")).count() == 0


def test_decode_legacy_knowledge_long_text(spark):
    """A quoted text of 200,000 characters, and a chain of escapes."""
    long = "x" * 200_000
    rows = [("{'contexts': ['" + long + "', \"it's\"]}", f"{long}\nit's"), ("{'contexts': ['" + "\\\\'" * 300 + "']}", "'" * 300)]
    rows[1] = ("{'contexts': ['" + "\\'" * 300 + "']}", "'" * 300)
    df = spark.createDataFrame(rows, "k string, want string")
    assert all(r[0] == r[1] for r in df.select(decode_legacy_knowledge("k"), "want").collect())


def test_term_category_map_keeps_no_text_in_the_sort(spark):
    """A10 in one hash aggregation; nulls, blanks and unnumbered rows as in the
    plain form, which text row numbers still take."""
    from evalsmith.operators.terms import term_category_map

    rows = [
        (2, "a; b; a", ["x", " y", "z "]), (1, "a; c; d", ["p", "q"]), (None, "b; e", ["null", "n"]),
        (3, "c; f", [None, "last"]), (-5, "g; g", ["first", "second"]), (9, "h", None), (4, "d;i; j ", ["u", " "]),
    ]
    want = {"a": "z", "b": "y", "c": None, "e": "n", "f": "last", "g": "second", "d;i": "u", "j": ""}
    for kind in ("int", "long", "string"):
        own = [(None if r is None else str(10 + r) if kind == "string" else r, m, c) for r, m, c in rows]
        out = term_category_map(spark.createDataFrame(own, f"row_no {kind}, meshes string, categories array<string>"))
        assert {r["term"]: r["category"] for r in out.collect()} == want
        assert ("SortAggregate" in out._jdf.queryExecution().executedPlan().toString()) == (kind == "string")
