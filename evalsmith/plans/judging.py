"""Judge scoring bindings: replies -> labels -> metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import truncate_float
from ..functions.replies import guideline_reply_label, qa_reply_label
from ..operators.generation import draw_shown_answer
from ..operators.metrics import decision, guideline_judge_summary, qa_judge_metrics
from ..session import table
from .common import (
    SQL_DIFFICULTY,
    difficulty_from_size,
    explode_judges,
    hex_digit,
    key_text,
    pick,
    sql_hex_digit,
    sql_list,
)

# Synthetic reply banks (16 each), indexed by an md5 hex digit. Bank 0 is
# used when the true label is 0, bank 1 when it is 1; both mix right,
# wrong, abstaining and unparseable replies.
GUIDELINE_REPLIES_0 = [
    "0", "0", "Concordant.", "It follows the guideline", "supported", "0 - concordant", "correct", "0",
    "1", "violates rule R2", "unsure", "cannot determine", "2", "", "hmm", "answer: 0 or 1",
]
GUIDELINE_REPLIES_1 = [
    "1", "1", "violates R3", "Discordant", "not supported", "1 (violation)", "incorrect", "1",
    "0", "concordant", "not sure", "insufficient data", "2", "", "maybe", "answer: 2 or 1",
]
QA_REPLIES_0 = [
    "0", "0", "0", "Factual", "0 factual", "yes", "correct", "0",
    "1", "not sure", "pass", "skip", "2", "", "none", "10",
]
QA_REPLIES_1 = [
    "1", "1", "1", "Hallucinated 1", "not factual", "non-factual", "1.", "1",
    "0", "not sure", "pass", "2", "skip", "", "0", "10",
]
DRAW_SEED = 42


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels joined to the document columns the slices need.

    Only doc_id / n_chars / lang are read from ``documents`` (the text
    column is pruned at the scan). Spark picks the join strategy from
    sizes; nothing is forced to broadcast.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("case_id"),
        "label",
        difficulty_from_size("n_chars").alias("difficulty"),
        F.col("lang").alias("case_kind"),
    )


def guideline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = explode_judges(labelled_cases(spark, sf_dir))
    idx = hex_digit(key_text(F.col("case_id"), F.col("model_name")), 1)
    reply = F.when(F.col("label") == 1, pick(GUIDELINE_REPLIES_1, idx)).otherwise(pick(GUIDELINE_REPLIES_0, idx))
    return cases.withColumn("raw_model_output", reply).withColumn(
        "predicted_label", guideline_reply_label("raw_model_output")
    ).withColumn("decision", decision())


def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guideline judge summary (A3): overall, per difficulty, per kind (lang)."""
    return guideline_judge_summary(guideline_predictions(spark, sf_dir))


def guideline_reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + P11 per (case, judge)."""
    return guideline_predictions(spark, sf_dir).select(
        "case_id", "model_name", "raw_model_output", "predicted_label", "decision"
    )


def qa_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "labels").select("doc_id").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    items = docs.select(
        F.col("doc_id").cast("string").alias("item_id"),
        difficulty_from_size("n_chars").alias("final_difficulty_level"),
    ).withColumn("label", draw_shown_answer("item_id", DRAW_SEED))
    items = explode_judges(items).withColumn("knowledge", F.explode(F.array(F.lit("No"), F.lit("Yes"))))
    idx = hex_digit(key_text(F.col("item_id"), F.col("model_name"), F.col("knowledge")), 1)
    reply = F.when(F.col("label") == 1, pick(QA_REPLIES_1, idx)).otherwise(pick(QA_REPLIES_0, idx))
    return items.withColumn("raw_model_output", reply).withColumn(
        "predicted_label", qa_reply_label("raw_model_output")
    )


def qa_judge_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA judge metrics (A1), one wide row per (judge, knowledge flag)."""
    return qa_judge_metrics(qa_predictions(spark, sf_dir))


def truncate_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on signed values derived from lineitem (every row)."""
    li = table(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        truncate_float(signed * F.col("l_extendedprice") * F.col("l_discount") / 7.0, 3).alias("disc_value"),
        truncate_float(signed * F.col("l_tax") / 3.0, 2).alias("tax_share"),
    )


def draw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 over the benchmark items: which answer each item shows."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"))
    return b.withColumn("label", draw_shown_answer("item_id", DRAW_SEED)).withColumn(
        "shown", F.when(F.col("label") == 1, "hallucinated_answer").otherwise("ground_truth")
    )


# -- DuckDB oracles -------------------------------------------------------------


def _sql_contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _sql_guideline_label(x: str) -> str:
    from ..functions.replies import (
        GUIDELINE_CONCORDANT_WORDS,
        GUIDELINE_UNSURE_WORDS,
        GUIDELINE_VIOLATION_WORDS,
    )

    t = f"lower(trim({x}))"
    d = f"regexp_extract({t}, '[012]', 0)"
    return (
        f"CASE WHEN {d} <> '' THEN CAST({d} AS INTEGER) "
        f"WHEN {_sql_contains_any(t, GUIDELINE_UNSURE_WORDS)} THEN 2 "
        f"WHEN {_sql_contains_any(t, GUIDELINE_VIOLATION_WORDS)} THEN 1 "
        f"WHEN {_sql_contains_any(t, GUIDELINE_CONCORDANT_WORDS)} THEN 0 ELSE 2 END"
    )


def _sql_qa_label(x: str) -> str:
    from ..functions.replies import QA_ABSTAIN_WORDS, QA_HALLUCINATED_WORDS

    t = f"lower({x})"
    return (
        f"CASE WHEN {_sql_contains_any(t, QA_HALLUCINATED_WORDS)} THEN 1 "
        f"WHEN {_sql_contains_any(t, QA_ABSTAIN_WORDS)} THEN 2 ELSE 0 END"
    )


def _sql_trunc(x: str, digits: int = 3) -> str:
    f = 10**digits
    return f"(trunc(({x}) * {f}.0) / {f}.0)"


def _sql_div(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) <> 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END)"


_SQL_GUIDE_PRED = f"""
WITH cases AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS case_id, l.toxic AS label,
         {SQL_DIFFICULTY} AS difficulty, d.lang AS case_kind
  FROM labels l JOIN documents d USING (doc_id)
), judged AS (
  SELECT c.*, m.model_name FROM cases c,
         (SELECT unnest(['judge_a', 'judge_b']) AS model_name) m
), replied AS (
  SELECT *, CASE WHEN label = 1
           THEN {sql_list(GUIDELINE_REPLIES_1)}[{sql_hex_digit("case_id || ':' || model_name", 1)} + 1]
           ELSE {sql_list(GUIDELINE_REPLIES_0)}[{sql_hex_digit("case_id || ':' || model_name", 1)} + 1] END
         AS raw_model_output
  FROM judged
), preds AS (
  SELECT *, {_sql_guideline_label("raw_model_output")} AS predicted_label FROM replied
)
"""


def _sql_metric_select(prefix: str = "", zero_when_all_abstain: bool = False, cond: str | None = None) -> str:
    """Counts for one slice as SQL aggregate expressions."""
    w = (lambda c: f"count_if(({cond}) AND ({c}))") if cond else (lambda c: f"count_if({c})")
    n = f"count_if({cond})" if cond else "count(*)"
    return {
        "n": n,
        "ab": w("predicted_label = 2"),
        "tp": w("predicted_label = 1 AND label = 1"),
        "fp": w("predicted_label = 1 AND label = 0"),
        "fn": w("predicted_label = 0 AND label = 1"),
        "tn": w("predicted_label = 0 AND label = 0"),
    }


def _sql_ratio_cols(c: dict, all_zero: bool) -> dict:
    dec = f"({c['n']} - {c['ab']})"
    null_or_zero = "0.0" if all_zero else "NULL"
    return {
        "accuracy": f"CASE WHEN {dec} > 0 THEN {_sql_trunc(_sql_div(c['tp'] + ' + ' + c['tn'], dec))} END",
        "precision": f"CASE WHEN {dec} > 0 THEN {_sql_trunc(_sql_div(c['tp'], c['tp'] + ' + ' + c['fp']))} ELSE {null_or_zero} END",
        "recall": f"CASE WHEN {dec} > 0 THEN {_sql_trunc(_sql_div(c['tp'], c['tp'] + ' + ' + c['fn']))} ELSE {null_or_zero} END",
        "f1": f"CASE WHEN {dec} > 0 THEN {_sql_trunc(_sql_div('2 * ' + c['tp'], '2 * ' + c['tp'] + ' + ' + c['fp'] + ' + ' + c['fn']))} ELSE {null_or_zero} END",
        "abstain_rate": f"CASE WHEN {c['n']} > 0 THEN {_sql_trunc(c['ab'] + ' / ' + c['n'])} END",
        "coverage": f"CASE WHEN {c['n']} > 0 THEN {_sql_trunc(dec + ' / ' + c['n'])} END",
    }


def _judge_summary_sql() -> str:
    c = _sql_metric_select()
    r = _sql_ratio_cols(c, all_zero=False)
    return (
        _SQL_GUIDE_PRED
        + f"""
SELECT model_name,
  CASE WHEN grouping(difficulty) = 0 THEN coalesce(difficulty, 'nan')
       WHEN grouping(case_kind) = 0 THEN coalesce(case_kind, 'nan') ELSE 'overall' END AS slice_name,
  CASE WHEN grouping(difficulty) = 0 THEN 1 WHEN grouping(case_kind) = 0 THEN 2 ELSE 0 END AS slice_rank,
  {r['accuracy']} AS accuracy, {r['precision']} AS precision, {r['recall']} AS recall, {r['f1']} AS f1,
  {r['abstain_rate']} AS abstain_rate, {r['coverage']} AS coverage, CAST(count(*) AS BIGINT) AS support
FROM preds
GROUP BY GROUPING SETS ((model_name), (model_name, difficulty), (model_name, case_kind))
"""
    )


def _guideline_reply_labels_sql() -> str:
    return (
        _SQL_GUIDE_PRED
        + """
SELECT case_id, model_name, raw_model_output, predicted_label,
  CASE WHEN predicted_label = label THEN 'Correct' WHEN predicted_label = 2 THEN 'Not Sure' ELSE 'Incorrect' END AS decision
FROM preds
"""
    )


def _sql_draw(key: str) -> str:
    seeded = f"{key} || ':' || '{DRAW_SEED}'"
    return f"({sql_hex_digit(seeded, 32)} % 2)"


def _qa_judge_wide_sql() -> str:
    key = "item_id || ':' || model_name || ':' || knowledge"
    parts = []
    for lvl in ["easy", "medium", "hard"]:
        c = _sql_metric_select(cond=f"final_difficulty_level = '{lvl}'")
        r = _sql_ratio_cols(c, all_zero=False)
        present = f"{c['n']} > 0"
        parts.append(f"CASE WHEN {present} THEN {r['abstain_rate']} END AS {lvl}_percent_of_time_not_sure_chosen")
        for k in ("accuracy", "precision", "recall", "f1"):
            parts.append(f"CASE WHEN {present} THEN {r[k]} END AS {lvl}_{k}")
    c = _sql_metric_select()
    r = _sql_ratio_cols(c, all_zero=True)
    return f"""
WITH items AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS item_id, {SQL_DIFFICULTY} AS final_difficulty_level
  FROM labels l JOIN documents d USING (doc_id)
), lab AS (
  SELECT *, {_sql_draw('item_id')} AS label FROM items
), judged AS (
  SELECT lab.*, m.model_name, k.knowledge FROM lab,
    (SELECT unnest(['judge_a', 'judge_b']) AS model_name) m,
    (SELECT unnest(['No', 'Yes']) AS knowledge) k
), replied AS (
  SELECT *, CASE WHEN label = 1 THEN {sql_list(QA_REPLIES_1)}[{sql_hex_digit(key, 1)} + 1]
                 ELSE {sql_list(QA_REPLIES_0)}[{sql_hex_digit(key, 1)} + 1] END AS raw_model_output
  FROM judged
), preds AS (SELECT *, {_sql_qa_label('raw_model_output')} AS predicted_label FROM replied)
SELECT {', '.join(parts)}, model_name, knowledge,
  {r['precision']} AS precision, {r['recall']} AS recall, {r['f1']} AS f1,
  {r['abstain_rate']} AS overall_percent_of_time_not_sure_chosen
FROM preds GROUP BY model_name, knowledge
"""


_TRUNCATE_PRICES_SQL = """
SELECT l_orderkey, l_linenumber,
  trunc((CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END) * l_extendedprice * l_discount / 7.0 * 1000.0) / 1000.0 AS disc_value,
  trunc((CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END) * l_tax / 3.0 * 100.0) / 100.0 AS tax_share
FROM lineitem
"""


def _draw_answers_sql() -> str:
    return f"""
SELECT CAST(item_id AS VARCHAR) AS item_id,
  CAST({_sql_draw('CAST(item_id AS VARCHAR)')} AS INTEGER) AS label,
  CASE WHEN {_sql_draw('CAST(item_id AS VARCHAR)')} = 1 THEN 'hallucinated_answer' ELSE 'ground_truth' END AS shown
FROM benchmark
"""


QUERIES = {
    "judge_summary": judge_summary,
    "qa_judge_wide": qa_judge_wide,
    "guideline_reply_labels": guideline_reply_labels,
    "truncate_prices": truncate_prices,
    "draw_answers": draw_answers,
}


def oracles() -> dict[str, str]:
    return {
        "judge_summary": _judge_summary_sql(),
        "qa_judge_wide": _qa_judge_wide_sql(),
        "guideline_reply_labels": _guideline_reply_labels_sql(),
        "truncate_prices": _TRUNCATE_PRICES_SQL,
        "draw_answers": _draw_answers_sql(),
    }
