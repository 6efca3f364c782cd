"""Model calls over batches (U1) and generate-judge-revise rounds.

The model is a caller-supplied Python function over a pandas Series of
prompts (or pairs). It runs in ``mapInPandas``: Arrow batches, one model
load per task, parallelism set by the input partitioning. Only the prompt
key and text cross into Python; filters and projections stay before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import answer_sections, fooled
from ..session import store
from .generation import any_fooled, difficulty_from_votes, pending
from .prompts import revision_prompt


def _ship_package_by_value() -> None:
    """Pickle this package's functions by value, so Python workers run the
    batch functions without the package installed on the executors."""
    try:
        import importlib

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(importlib.import_module(__name__.split(".")[0]))
    except Exception:  # noqa: BLE001 - older cloudpickle: ship with --py-files
        pass


_ship_package_by_value()


#: What a failed model call raises. Anything else is a mistake in the
#: caller's code and fails the job.
CALL_FAILURES = (OSError, RuntimeError, ValueError)


def _call(fn: Callable, batch: pd.DataFrame, failures: tuple) -> tuple[list, list]:
    """(outputs, errors) of one batch; if the call fails, row by row."""
    try:
        return list(fn(batch)), [None] * len(batch)
    except failures as e:
        if len(batch) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    parts = [_call(fn, batch.iloc[i : i + 1], failures) for i in range(len(batch))]
    return [x for out, _ in parts for x in out], [x for _, err in parts for x in err]


def score_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    key_cols: list[str],
    input_cols: list[str],
    out_col: str = "raw_output",
    out_type: str = "string",
    partitions: int | None = None,
    load: Callable[[], object] | None = None,
    error_col: str = "error",
    failures: tuple = CALL_FAILURES,
) -> DataFrame:
    """Run ``fn`` over batches of ``input_cols``; returns keys, output and
    ``error_col``.

    ``load`` (optional) builds the model once per task and is passed to
    ``fn(batch, model)``. When a call fails with one of ``failures``, its rows
    are called one by one; a row that still fails has a null output and the
    error's text, and the others keep theirs.
    """
    cols = list(dict.fromkeys(key_cols + input_cols))
    src = df.select(*cols)
    if partitions:
        src = src.repartition(partitions)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in key_cols])
    schema += f", `{out_col}` {out_type}, `{error_col}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if load is None:
            call = fn
        else:
            model = load()
            call = lambda b: fn(b, model)
        for b in batches:
            res = b[key_cols].copy()
            res[out_col], res[error_col] = _call(call, b[input_cols], failures)
            yield res

    return src.mapInPandas(run, schema)


def attach_responses(cases: DataFrame, responses: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Replies to cases by key, never by position; ``how="left"``
    surfaces cases whose reply is missing (null ``raw_output``)."""
    return cases.join(responses, keys, how)


def refine_rounds(
    items: DataFrame,
    key: str,
    generate: Callable[[pd.DataFrame], pd.Series],
    judges: list[Callable[[pd.DataFrame], pd.Series]],
    revise: Callable[[pd.DataFrame], pd.Series],
    rounds: int,
    prompt_col: str = "prompt",
    done: DataFrame | None = None,
) -> DataFrame:
    """Up to ``rounds`` rounds over all pending items at once.

    Each round: generate a reply per pending item (one column, the prompt) and
    ask every judge about its answer. Where no judge was fooled, ``revise``
    (prompt, answer, reasoning of the judges) gives feedback, a prompt with
    that previous attempt is generated from, and the judges are asked again.
    Items that fooled a judge leave the pool.

    The answer is the reply's answer section (F4), or the whole reply without
    one. An empty or failed reply is a skipped attempt: it has no row, and the
    item stays in the pool.

    Every model output is written to the shared folder before anything reads
    it, so each call is made once and what is stored is what was judged, even
    if the model answers differently each time or an executor is lost. All
    judges run in one pass. Returns the long attempts table (item, attempt_no,
    stage, answer, justification, votes, any_fooled, difficulty).
    """
    pool = store(items.select(key, prompt_col) if done is None else pending(items.select(key, prompt_col), done, key), "refine-pool")
    attempts = []

    def attempt(prompts: DataFrame, prompt: str, rnd: int, stage: str) -> DataFrame:
        replies = score_batches(prompts, generate, [key], [prompt], "_reply")
        parts = answer_sections("_reply")
        answer = F.coalesce(F.nullif(parts["hallucinated_answer"], F.lit("")), F.col("_reply"))
        said = replies.where(F.coalesce(F.col("_reply"), F.lit("")) != "").select(
            key, answer.alias("answer"), parts["justification_of_hallucinated_answer"].alias("justification")
        )
        judged = _judge(store(said, f"refine-{stage}"), key, judges)
        judged = judged.withColumn("attempt_no", F.lit(2 * rnd - (stage == "generate"))).withColumn("stage", F.lit(stage))
        judged = store(judged, f"refine-{stage}-judged")
        attempts.append(judged.drop("reasoning"))
        return judged

    for rnd in range(1, rounds + 1):
        judged = attempt(pool, prompt_col, rnd, "generate")
        failed = judged.where(~F.col("any_fooled")).select(key, "answer", "reasoning").join(pool, key)
        feedback = score_batches(failed, revise, [key, prompt_col], [prompt_col, "answer", "reasoning"], "_feedback")
        again = store(feedback.select(key, revision_prompt(F.col(prompt_col), F.col("_feedback")).alias("_prompt")), "refine-feedback")
        rejudged = attempt(again, "_prompt", rnd, "revise")
        succeeded = judged.where("any_fooled").select(key).unionAll(rejudged.where("any_fooled").select(key))
        pool = store(pool.join(succeeded, key, "left_anti"), "refine-pool")
        if pool.isEmpty():
            break
    out = attempts[0]
    for more in attempts[1:]:
        out = out.unionByName(more)
    return out


def _judge(answers: DataFrame, key: str, judges: list[Callable]) -> DataFrame:
    """``answers`` with votes of all judges, asked batch by batch in one pass;
    ``reasoning`` is what they replied."""

    def ask(batch: pd.DataFrame) -> pd.Series:
        texts = batch[["answer"]]
        replies = [_call(judge, texts, CALL_FAILURES)[0] for judge in judges]
        return pd.Series([list(r) for r in zip(*replies, strict=True)] if judges else [[] for _ in range(len(batch))], dtype=object)

    asked = score_batches(answers, ask, answers.columns, ["answer"], "_replies", "array<string>")
    return (
        asked.withColumn("votes", F.transform("_replies", fooled))
        .withColumn("any_fooled", any_fooled("votes"))
        .withColumn("difficulty", difficulty_from_votes("votes"))
        .withColumn("reasoning", F.array_join(F.filter("_replies", lambda r: r != ""), "Reasons: "))
        .drop("_replies", "error")
    )
