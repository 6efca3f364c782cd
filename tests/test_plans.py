"""Plan checks over every registered query of the library: no Cartesian
product or nested-loop join and Python only where it belongs, in the final plan
and in every table that is written or checkpointed while the query is built."""

import pytest
from pyspark.sql import DataFrameWriter

from evalsmith.operators.rules import explode_rules, extraction_method_counts
from evalsmith.plans import registry

SMOKE = "/root/testdata/sf0.001"
# Model calls, vector blocks, and the ordered pass over what parallel rounds leave.
PYTHON_ALLOWED = {"score_batches", "refine_rounds", "nearest_vectors", "nearest_recall"}
ORDERED_PASS = {"greedy_match", "action_summary", "diagnose", "diagnostics_table", "rescore_saved", "semantic_dedup"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def plans(spark, monkeypatch):
    """Plans of all tables written or checkpointed during a test."""
    seen = []
    write, checkpoint = DataFrameWriter.parquet, type(spark.range(0)).checkpoint
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(_plan(self._df)), write(self, *a, **k))[1])
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **k: (seen.append(_plan(self)), checkpoint(self, *a, **k))[1])
    return seen


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_plans(spark, plans, name):
    final = _plan(registry.queries()[name](spark, SMOKE))
    for plan in [*plans, final]:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        if name not in PYTHON_ALLOWED:
            found = [p for p in PYTHON_NODES if p in plan]
            assert not found or name in ORDERED_PASS and found == ["MapInPandas"]
    assert any("FileScan parquet" in plan for plan in [*plans, final])


@pytest.mark.parametrize("name", ["near_miss_cases", "reference_cases", "guideline_text", "text_labels", "record_rules"])
def test_map_only(spark, plans, name):
    plan = _plan(registry.queries()[name](spark, SMOKE))
    assert not plans and "Exchange" not in plan and plan.count("FileScan parquet") == 1


def test_scan_pruning(spark):
    """The document text column is never read for the judge summary."""
    plan = _plan(registry.queries()["judge_summary"](spark, SMOKE))
    schemas = [x.split(">")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert len(schemas) == 2 and all("doc_id" in x for x in schemas)
    assert not any("text:" in x for x in schemas)


def test_index_range_reaches_the_scan(spark):
    from evalsmith.operators.cases import select_index_range

    d = spark.read.parquet(f"{SMOKE}/documents.parquet")
    plan = _plan(select_index_range(d, 3, 9, "doc_id"))
    assert "GreaterThanOrEqual(doc_id,3)" in plan.split("PushedFilters")[1]


def test_explode_rules_and_method_counts(spark):
    df = spark.createDataFrame(
        [(1, [("R1", 5)], ("llm",)), (2, [], ("llm_failed",)), (3, None, ("llm",))],
        "record_index int, rules array<struct<rule_id:string,priority:int>>, meta struct<m:string>",
    )
    rows = explode_rules(df).collect()
    assert len(rows) == 3 and rows[0]["rule_id"] == "R1"
    counts = {r[0]: r[1] for r in extraction_method_counts(df, "meta.m").collect()}
    assert counts == {"llm": 2, "llm_failed": 1}
