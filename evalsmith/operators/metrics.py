"""Judge metrics with abstention.

Metrics are computed from exact counts (TP, FP, FN, TN, abstained, total)
in ONE aggregation pass, ratios afterwards. Every aggregate is algebraic, so
Spark combines partially on the map side and shuffles one small row per
(group, partition); a hot model or slice never gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import safe_div, truncate_float

# The QA judge reports exactly these difficulty levels.
QA_DIFFICULTIES = ["easy", "medium", "hard"]


def decision(pred="predicted_label", label="label") -> Column:
    """Correct / Not Sure / Incorrect."""
    p, y = F.col(pred) if isinstance(pred, str) else pred, F.col(label) if isinstance(label, str) else label
    return F.when(p == y, "Correct").when(p == 2, "Not Sure").otherwise("Incorrect")


def truncate_floats(df: DataFrame, digits: int = 3) -> DataFrame:
    """P10 over a table: every float / double column truncated, others untouched."""
    if digits < 0:
        raise ValueError("digits must be >= 0")
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(truncate_float(F.col(f"`{f.name}`"), digits).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def _counts(pred: Column, label: Column, cond: Column | None = None, prefix: str = "") -> list[Column]:
    def ci(c):
        return F.count_if(c if cond is None else (cond & c))

    n = F.count_if(F.lit(True) if cond is None else cond)
    return [
        n.alias(f"{prefix}n"),
        ci(pred == 2).alias(f"{prefix}abstained"),
        ci((pred == 1) & (label == 1)).alias(f"{prefix}tp"),
        ci((pred == 1) & (label == 0)).alias(f"{prefix}fp"),
        ci((pred == 0) & (label == 1)).alias(f"{prefix}fn"),
        ci((pred == 0) & (label == 0)).alias(f"{prefix}tn"),
    ]


def _ratios(prefix: str, all_abstained_zero: bool) -> dict[str, Column]:
    """Accuracy / P / R / F1 over decided rows; abstain rate over all rows."""
    c = lambda k: F.col(f"{prefix}{k}")
    decided = c("n") - c("abstained")
    acc = safe_div(c("tp") + c("tn"), decided)
    prec = safe_div(c("tp"), c("tp") + c("fp"))
    rec = safe_div(c("tp"), c("tp") + c("fn"))
    f1 = safe_div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))
    none = F.lit(None).cast("double")
    some = decided > 0
    fill = F.lit(0.0) if all_abstained_zero else none
    return {
        "accuracy": F.when(some, acc).otherwise(none),
        "precision": F.when(some, prec).otherwise(fill),
        "recall": F.when(some, rec).otherwise(fill),
        "f1": F.when(some, f1).otherwise(fill),
        "abstain_rate": F.when(c("n") > 0, c("abstained") / c("n")),
        "coverage": F.when(c("n") > 0, decided / c("n")),
    }


def abstaining_binary_metrics(
    preds: DataFrame,
    group_cols: Sequence[str],
    pred: str = "predicted_label",
    label: str = "label",
    digits: int | None = 3,
) -> DataFrame:
    """A2 per group: accuracy, precision, recall, F1 over rows with a 0/1
    prediction; abstain rate, coverage and support over all rows. The four
    are null when every row abstained; 0/0 gives 0.0 (positive class 1)."""
    agg = preds.groupBy(*group_cols).agg(*_counts(F.col(pred), F.col(label)))
    r = _ratios("", all_abstained_zero=False)
    out = agg.select(
        *group_cols,
        *[v.alias(k) for k, v in r.items()],
        F.col("n").alias("support"),
    )
    return truncate_floats(out, digits) if digits is not None else out


def guideline_judge_summary(
    preds: DataFrame,
    model: str = "model_name",
    slices: Sequence[str] = ("difficulty", "case_kind"),
    pred: str = "predicted_label",
    label: str = "label",
    digits: int | None = 3,
) -> DataFrame:
    """A3: A2 for overall and for each value of each slice column, per model,
    in one grouping-sets pass (Expand + partial aggregation, one shuffle).

    A null slice value is kept and named ``nan``; ``slice_rank`` orders
    overall first, then the slice columns in the given order (Q20).
    """
    sets = [[model]] + [[model, s] for s in slices]
    g = preds.groupingSets(sets, model, *slices).agg(
        *_counts(F.col(pred), F.col(label)),
        *[F.grouping(s).alias(f"_g_{s}") for s in slices],
    )
    name = F.lit("overall")
    rank = F.lit(0)
    for i, s in reversed(list(enumerate(slices))):
        hit = F.col(f"_g_{s}") == 0
        name = F.when(hit, F.coalesce(F.col(s).cast("string"), F.lit("nan"))).otherwise(name)
        rank = F.when(hit, F.lit(i + 1)).otherwise(rank)
    r = _ratios("", all_abstained_zero=False)
    out = g.select(
        F.col(model),
        name.alias("slice_name"),
        rank.alias("slice_rank"),
        *[v.alias(k) for k, v in r.items()],
        F.col("n").alias("support"),
    )
    return truncate_floats(out, digits) if digits is not None else out


def action_summary(
    matches: DataFrame,
    model: str = "model_name",
    kind: str = "case_kind",
    digits: int | None = 3,
) -> DataFrame:
    """A4: per model, overall / per case kind / per reference-action count:
    exact-match rate (also as ``case_accuracy``), mean P / R / F1 / match
    score, hallucination-free and full-recall rates, mean list sizes and
    support. One grouping-sets pass; every aggregate is algebraic."""
    nref = "num_reference_actions"
    g = matches.groupingSets([[model], [model, kind], [model, nref]], model, kind, nref).agg(
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"),
        F.avg("action_precision").alias("mean_action_precision"),
        F.avg("action_recall").alias("mean_action_recall"),
        F.avg("action_f1").alias("mean_action_f1"),
        F.avg("average_match_score").alias("mean_match_score"),
        F.avg((F.col("num_unmatched_generated_actions") == 0).cast("double")).alias("hallucination_free_rate"),
        F.avg((F.col("num_unmatched_reference_actions") == 0).cast("double")).alias("full_recall_rate"),
        F.avg(F.col("num_generated_actions").cast("double")).alias("mean_generated_actions"),
        F.avg(F.col(nref).cast("double")).alias("mean_reference_actions"),
        F.count("*").alias("support"),
        F.grouping(kind).alias("_gk"),
        F.grouping(nref).alias("_gn"),
    )
    name = (
        F.when(F.col("_gk") == 0, F.coalesce(F.col(kind).cast("string"), F.lit("nan")))
        .when(F.col("_gn") == 0, F.concat(F.lit("reference_actions_"), F.col(nref).cast("string")))
        .otherwise(F.lit("overall"))
    )
    rank = F.when(F.col("_gk") == 0, 1).when(F.col("_gn") == 0, 2).otherwise(0)
    # Means of doubles depend on summation order in the last bits; rounding
    # to 9 decimals before the 3-decimal truncation keeps e.g. 2.1 / 5 at
    # 0.42 in every engine and partition layout.
    for c in [c for c in g.columns if c.startswith(("mean_", "exact_", "hallucination_", "full_"))]:
        g = g.withColumn(c, F.round(c, 9))
    out = g.select(
        model,
        name.alias("slice_name"),
        rank.alias("slice_rank"),
        F.col("exact_match_rate").alias("case_accuracy"),
        "exact_match_rate",
        "mean_action_precision",
        "mean_action_recall",
        "mean_action_f1",
        "mean_match_score",
        "hallucination_free_rate",
        "full_recall_rate",
        "mean_generated_actions",
        "mean_reference_actions",
        "support",
    )
    return truncate_floats(out, digits) if digits is not None else out


def qa_judge_metrics(
    preds: DataFrame,
    keys: Sequence[str] = ("model_name", "knowledge"),
    difficulty: str = "final_difficulty_level",
    pred: str = "predicted_label",
    label: str = "label",
    digits: int | None = 3,
) -> DataFrame:
    """A1: one wide row per (model, knowledge).

    Per difficulty in easy / medium / hard: not-sure rate, accuracy, P, R,
    F1 over decided rows (null when the level is absent or all abstained).
    Overall: P, R, F1 over decided rows (0 when all abstained, Q3) and the
    not-sure rate; no overall accuracy. The difficulty levels are fixed, so
    the pivot is a static set of conditional counts in the same single
    aggregation, with no second shuffle.
    """
    p, y, d = F.col(pred), F.col(label), F.col(difficulty)
    aggs = _counts(p, y, prefix="all_")
    for lvl in QA_DIFFICULTIES:
        aggs += _counts(p, y, cond=(d == lvl), prefix=f"{lvl}_")
    g = preds.groupBy(*keys).agg(*aggs)
    cols = []
    for lvl in QA_DIFFICULTIES:
        r = _ratios(f"{lvl}_", all_abstained_zero=False)
        present = F.col(f"{lvl}_n") > 0
        cols.append(F.when(present, r["abstain_rate"]).alias(f"{lvl}_percent_of_time_not_sure_chosen"))
        for k in ("accuracy", "precision", "recall", "f1"):
            cols.append(F.when(present, r[k]).alias(f"{lvl}_{k}"))
    overall = _ratios("all_", all_abstained_zero=True)
    out = g.select(
        *cols,
        *keys,
        overall["precision"].alias("precision"),
        overall["recall"].alias("recall"),
        overall["f1"].alias("f1"),
        overall["abstain_rate"].alias("overall_percent_of_time_not_sure_chosen"),
    )
    return truncate_floats(out, digits) if digits is not None else out
