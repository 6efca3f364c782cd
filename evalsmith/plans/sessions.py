"""Log sessionization bindings on ``events``.

The payloads hold no query marker, so the texts cut from them are null here
(``log_texts`` cuts real ones).

Each user's events in event_id order are one ordered log: ``signup`` opens
a step, ``click`` / ``view`` / ``error`` fill fields (last one wins),
``purchase`` closes it; every 3 closed steps form a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import run_records, sessionize_steps
from ..session import table

START, CLOSE = "signup", "purchase"
FIELDS = {"click": "backward_gradient", "view": "optimizer_prompt", "error": "optimizer_response"}
STEPS_PER_RUN = 3


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type",
        F.concat_ws(" ", F.col("props"), F.format_string("value=%.2f", F.col("value"))).alias("payload"),
    )
    return sessionize_steps(e, "user_id", "event_id", "event_type", "payload", START, CLOSE, FIELDS, STEPS_PER_RUN)


def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_steps(spark, sf_dir)


def session_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_records(event_steps(spark, sf_dir), "user_id", STEPS_PER_RUN)


QUERIES = {"session_steps": session_steps, "session_runs": session_runs}

_STEPS_SQL = f"""
WITH l AS (
  SELECT user_id, event_id, trim(event_type) AS msg,
    nullif(trim(concat_ws(' ', props, printf('value=%.2f', value))), '') AS val
  FROM events
), s AS (
  SELECT *, sum(CASE WHEN msg = '{START}' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step
  FROM l
), c AS (
  SELECT user_id, step, min(event_id) AS close FROM s WHERE step > 0 AND msg = '{CLOSE}' GROUP BY user_id, step
), ins AS (
  SELECT s.*, c.close FROM s JOIN c ON s.user_id = c.user_id AND s.step = c.step WHERE s.event_id <= c.close
), st AS (
  SELECT user_id, step,
    arg_min_null(val, event_id) FILTER (WHERE msg = '{START}') AS evaluation_trace,
    CAST(NULL AS VARCHAR) AS backward_prompt,
    arg_max_null(val, event_id) FILTER (WHERE msg = 'click') AS backward_gradient,
    arg_max_null(val, event_id) FILTER (WHERE msg = 'view') AS optimizer_prompt,
    arg_max_null(val, event_id) FILTER (WHERE msg = 'error') AS optimizer_response,
    arg_max_null(val, event_id) FILTER (WHERE event_id = close) AS updated_text
  FROM ins GROUP BY user_id, step
), num AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY step) AS BIGINT) AS step_no FROM st
)"""


def _steps_sql() -> str:
    return _STEPS_SQL + f"""
SELECT user_id, step_no, CAST((step_no - 1) // {STEPS_PER_RUN} + 1 AS BIGINT) AS run_no,
  CAST((step_no - 1) % {STEPS_PER_RUN} + 1 AS INTEGER) AS pos_in_run,
  evaluation_trace, backward_prompt, backward_gradient, optimizer_prompt, optimizer_response, updated_text
FROM num
"""


def _runs_sql() -> str:
    return _STEPS_SQL + f"""
, runs AS (SELECT *, CAST((step_no - 1) // {STEPS_PER_RUN} + 1 AS BIGINT) AS run_no FROM num)
SELECT user_id, run_no AS optimization_index, count(*) AS step_count, count(*) <> {STEPS_PER_RUN} AS is_partial,
  CAST(NULL AS VARCHAR) AS question, CAST(NULL AS VARCHAR) AS initial_text, CAST(NULL AS VARCHAR) AS reconstructed_follow_up_prompt,
  arg_max_null(optimizer_response, step_no) AS final_optimizer_response,
  arg_max_null(updated_text, step_no) AS final_updated_text
FROM runs GROUP BY user_id, run_no
"""


def oracles() -> dict[str, str]:
    return {"session_steps": _steps_sql(), "session_runs": _runs_sql()}
