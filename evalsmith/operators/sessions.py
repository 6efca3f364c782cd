"""Ordered-log sessionization into steps and runs.

A log is a table ``(part, order, message, payload)``: ``part`` is the file
(or user) whose lines form one ordered stream. A start message opens a step
(an open, unclosed step is discarded), later messages fill fields (last one
wins), the first close message ends the step, and lines outside a step are
ignored. Every ``n`` closed steps form one run; a short last run is partial.

Skew: the running counts that assign step and closed-step numbers are
computed per (part, chunk of the order column) plus a per-chunk offset, so
a part holding a third of all lines is spread over many window partitions
instead of one sorted task. Everything else is algebraic per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import materialize

# ---------------------------------------------------------------------------
# Log markers and question patterns of the optimizer logs.
START_MESSAGE = "LLMCall function forward"
CLOSE_MESSAGE = "TextualGradientDescent updated text"
FIELD_MESSAGES = {
    "_backward_through_llm prompt": ("backward_prompt", "_backward_through_llm"),
    "_backward_through_llm gradient": ("backward_gradient", "_backward_through_llm"),
    "TextualGradientDescent prompt for update": ("optimizer_prompt", "prompt"),
    "TextualGradientDescent optimizer response": ("optimizer_response", "optimizer.response"),
}
START_PAYLOAD = "text"
CLOSE_PAYLOAD = "parameter.value"
HALLUCINATED_ANSWER_MARKER = "#Hallucinated Answer#:"
QUERY_MARKER = "\nQuery: "
RESPONSE_MARKER = "\nResponse: "
VARIABLE_TAG_PATTERN = r"(?s)<VARIABLE>\s*(.*?)\s*</VARIABLE>"
QUESTION_PATTERNS = [
    r"(?s)#Question#:\s*(.*?)\n\n(?:#Knowledge#:|#Answer#:|#Ground truth answer#:|#Hallucinated Answer#:)",
    r"(?s)(?:^|\n)Question:\s*(.*?)(?:\n\n(?:#|Short answer|Brief summary|One-line takeaway|Quick patient takeaway|Clinician note|Key points|Practical advice|Practical guidance|What to watch for|Evidence and limitations|References|Bottom line)|\n|$)",
    r"(?i)for this question:\s*(.*?)(?:\n|$)",
]
FOLLOW_UP_SENTENCE = "\n\nPrevious attempt improved by TextGrad: "
# ---------------------------------------------------------------------------

STEP_FIELDS = ["evaluation_trace", "backward_prompt", "backward_gradient", "optimizer_prompt", "optimizer_response", "updated_text"]


def running_count(df: DataFrame, part, order: str, flag: Column, out: str, chunk_width: int) -> DataFrame:
    """Inclusive running sum of ``flag`` per part (a column or a list of
    columns) in ``order`` (numeric), skew-safe.

    Rows are cut into chunks of ``chunk_width`` order values; a window runs
    per (part, chunk) and a small per-chunk table supplies the offset.
    """
    parts = [part] if isinstance(part, str) else list(part)
    d = df.withColumn("_flag", flag.cast("long")).withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_width)))
    per_chunk = d.groupBy(*parts, "_chunk").agg(F.sum("_flag").alias("_cnt"))
    wc = Window.partitionBy(*parts).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.withColumn("_off", F.coalesce(F.sum("_cnt").over(wc), F.lit(0))).drop("_cnt")
    wr = Window.partitionBy(*parts, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("_run", F.sum("_flag").over(wr))
        .join(offsets, [*parts, "_chunk"])
        .withColumn(out, F.col("_off") + F.col("_run"))
        .drop("_flag", "_chunk", "_run", "_off")
    )


def sessionize_steps(
    log: DataFrame,
    part: str,
    order: str,
    message: str,
    payload: str,
    start: str,
    close: str,
    field_messages: dict[str, str],
    n: int,
    chunk_width: int = 1 << 20,
) -> DataFrame:
    """Closed steps ``(part, step_no, run_no, pos_in_run, fields...)``.

    ``field_messages`` maps a message to the step field it fills; the start
    line's payload is ``evaluation_trace`` and the close line's
    ``updated_text``. Payloads are stripped; blank becomes null.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    msg = py_strip(F.coalesce(F.col(message), F.lit("")))
    val = py_strip(F.col(payload))
    # The line table is read by the chunk counts, the window and (after step
    # numbering) by both the close lookup and the field aggregation: it is
    # materialized at those two points instead of being recomputed per branch.
    lines = materialize(log.select(part, order, msg.alias("_msg"), F.when(val != "", val).alias("_val")))
    lines = running_count(lines, part, order, F.col("_msg") == start, "_step", chunk_width).filter(F.col("_step") > 0)
    lines = materialize(lines)
    closes = lines.filter(F.col("_msg") == close).groupBy(part, "_step").agg(F.min(order).alias("_close"))
    inside = lines.join(closes, [part, "_step"]).filter(F.col(order) <= F.col("_close"))

    def last(m: str) -> Column:
        hit = F.col("_msg") == m
        return F.max_by(F.when(hit, F.col("_val")), F.when(hit, F.col(order)))

    aggs = [
        F.min_by(F.col("_val"), F.when(F.col("_msg") == start, F.col(order))).alias("evaluation_trace"),
        F.max_by(F.col("_val"), F.when(F.col(order) == F.col("_close"), F.col(order))).alias("updated_text"),
    ]
    for m, field in field_messages.items():
        aggs.append(last(m).alias(field))
    steps = inside.groupBy(part, "_step").agg(*aggs)
    for f in STEP_FIELDS:
        if f not in steps.columns:
            steps = steps.withColumn(f, F.lit(None).cast("string"))
    steps = running_count(materialize(steps), part, "_step", F.lit(1), "step_no", chunk_width)
    return steps.select(
        part,
        "step_no",
        (F.floor((F.col("step_no") - 1) / n) + 1).cast("long").alias("run_no"),
        ((F.col("step_no") - 1) % n + 1).cast("int").alias("pos_in_run"),
        *STEP_FIELDS,
    )


def run_records(steps: DataFrame, part: str, n: int, include_steps: bool = False) -> DataFrame:
    """One row per run with its first and last step's texts (algebraic
    min_by / max_by on the step order)."""
    first = lambda c: F.min_by(F.col(c), F.col("step_no"))
    last = lambda c: F.max_by(F.col(c), F.col("step_no"))
    aggs = [
        F.count("*").alias("step_count"),
        first("evaluation_trace").alias("_first_trace"),
        first("optimizer_prompt").alias("_first_opt_prompt"),
        first("backward_prompt").alias("_first_bprompt"),
        first("backward_gradient").alias("_first_bgrad"),
        last("optimizer_response").alias("final_optimizer_response"),
        last("updated_text").alias("final_updated_text"),
    ]
    if include_steps:
        aggs.append(F.array_sort(F.collect_list(F.struct("pos_in_run", *STEP_FIELDS))).alias("steps"))
    g = steps.groupBy(part, "run_no").agg(*aggs)
    initial = F.coalesce(query_text(F.col("_first_trace")), variable_text(F.col("_first_opt_prompt")))
    g = g.withColumn("initial_text", initial)
    question = question_from(
        [F.col("initial_text"), F.col("final_updated_text"), F.col("_first_trace"), F.col("_first_opt_prompt"),
         F.col("_first_bprompt"), F.col("_first_bgrad"), F.col("final_optimizer_response")]
    )
    cols = [
        part,
        F.col("run_no").alias("optimization_index"),
        "step_count",
        (F.col("step_count") != n).alias("is_partial"),
        question.alias("question"),
        "initial_text",
        "final_optimizer_response",
        "final_updated_text",
        follow_up_prompt(F.col("initial_text"), F.col("final_updated_text")).alias("reconstructed_follow_up_prompt"),
    ]
    if include_steps:
        cols.append("steps")
    return g.select(*cols)


# -- F13 text extraction ---------------------------------------------------------


def query_text(trace: Column) -> Column:
    """Text between the first ``\\nQuery: `` and the last ``\\nResponse: ``."""
    has = trace.contains(QUERY_MARKER) & trace.contains(RESPONSE_MARKER)
    # everything after the FIRST query marker
    first_q = F.instr(trace, QUERY_MARKER)
    after = F.substring(trace, first_q + F.lit(len(QUERY_MARKER)), F.length(trace))
    # up to the LAST response marker
    rev = F.reverse(after)
    pos_rev = F.instr(rev, RESPONSE_MARKER[::-1])
    prompt = F.substring(after, 1, F.length(after) - pos_rev - F.lit(len(RESPONSE_MARKER)) + 1)
    ok = has & (pos_rev > 0)
    return F.when(ok, py_strip(prompt))


def variable_text(prompt: Column) -> Column:
    t = F.regexp_extract(prompt, VARIABLE_TAG_PATTERN, 1)
    return F.when(prompt.rlike(VARIABLE_TAG_PATTERN), py_strip(t))


def question_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pat in reversed(QUESTION_PATTERNS):
        hit = F.coalesce(text.rlike(pat), F.lit(False))
        out = F.when(hit, py_strip(F.regexp_extract(text, pat, 1))).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) != "", out)


def question_from(candidates: list[Column]) -> Column:
    """First non-empty question found in the candidates, in order."""
    qs = [question_of(c) for c in candidates]
    return F.coalesce(*[F.when(q != "", q) for q in qs])


def follow_up_prompt(initial: Column, improved: Column) -> Column:
    ok = (F.coalesce(initial, F.lit("")) != "") & (F.coalesce(improved, F.lit("")) != "") & initial.contains(
        HALLUCINATED_ANSWER_MARKER
    )
    prefix = F.concat(F.substring_index(initial, HALLUCINATED_ANSWER_MARKER, 1), F.lit(HALLUCINATED_ANSWER_MARKER))
    return F.when(ok, F.concat(prefix, F.lit(FOLLOW_UP_SENTENCE), improved))


def optimizer_log_lines(log: DataFrame) -> DataFrame:
    """Map a parsed optimizer log (S9 output) to ``(file, line_no, message,
    payload)``: each message reads its own key."""
    msg = py_strip(F.coalesce(F.nullif(F.col("msg"), F.lit("")), F.col("message")))
    payload = F.when(msg == START_MESSAGE, F.col(f"`{START_PAYLOAD}`")).when(msg == CLOSE_MESSAGE, F.col(f"`{CLOSE_PAYLOAD}`"))
    for m, (_, key) in FIELD_MESSAGES.items():
        payload = payload.when(msg == m, F.col(f"`{key}`"))
    return log.select("file", "line_no", msg.alias("message"), payload.alias("payload"))


def optimizer_runs(log: DataFrame, n: int = 3, include_steps: bool = False) -> DataFrame:
    """S9 -> W3 -> W4 for optimizer logs."""
    lines = optimizer_log_lines(log)
    steps = sessionize_steps(
        lines, "file", "line_no", "message", "payload", START_MESSAGE, CLOSE_MESSAGE,
        {m: f for m, (f, _) in FIELD_MESSAGES.items()}, n,
    )
    return run_records(steps, "file", n, include_steps)
