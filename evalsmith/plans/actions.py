"""Action generation scoring bindings.

Cases are conversation turns: the reference actions are the turn's
sentences; each judge's "generated" actions are the same sentences with
about a quarter dropped and the kept ones shortened (half to a third of
their words, half by one word), chosen by md5. Semantic de-duplication runs
over the lines of every whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import keep_first_distinct
from ..functions.similarity import similarity_label
from ..operators.diagnostics import diagnose, rescore_saved
from ..sources.readers import read_matched_pairs, read_predictions
from ..operators.matching import (
    attach_texts,
    case_pairs,
    explode_actions,
    greedy_pairs,
    keep_first_distinct_rows,
    match_metrics,
    overlap_candidates,
    semantic_dedup,
    token_pair_scores,
    tokenize,
)
from ..operators.metrics import action_summary, truncate_floats
from ..operators.rowwise import fits_row, row_candidates, row_case_pairs, row_matches, row_semantic_dedup, split_cases
from ..session import materialize, store, table
from .common import explode_judges, hex_digit, key_text

THRESHOLD = 0.5
SENTENCE_SPLIT = r"[.!?]\s+|\n"
KEYS = ["case_id", "model_name"]
LISTS = ["generated_actions", "reference_actions"]


def _generated(ref: Column, case_id: Column, model: Column) -> Column:
    def shorten(s, i):
        d = hex_digit(key_text(case_id, model, i), 1)
        words = F.split(s, " ")
        n = F.size(words)
        third = F.array_join(F.slice(words, 1, F.greatest(F.ceil(n / 3).cast("int"), F.lit(1))), " ")
        minus_one = F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(1))), " ")
        minus_one = F.when(n <= 1, F.lit("")).otherwise(minus_one)
        return F.when(d < 4, F.lit(None).cast("string")).when(d < 10, third).otherwise(minus_one)

    kept = F.filter(F.transform(ref, shorten), lambda x: x.isNotNull())
    return keep_first_distinct(kept)


def action_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (turn, judge) with reference and generated action lists."""
    c = table(spark, sf_dir, "conversations")
    base = c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"),
        F.col("role").alias("case_kind"),
        keep_first_distinct(F.split(F.col("text"), SENTENCE_SPLIT)).alias("reference_actions"),
    )
    cases = explode_judges(base)
    return cases.withColumn(
        "generated_actions", _generated(F.col("reference_actions"), F.col("case_id"), F.col("model_name"))
    )


def _exploded(cases: DataFrame):
    """Exploded, tokenized action lists, materialized once: each side feeds
    the token index, the probe prefixes and the text lookups."""
    gen = materialize(tokenize(explode_actions(cases, KEYS, "generated_actions")))
    ref = materialize(tokenize(explode_actions(cases, KEYS, "reference_actions")))
    return gen, ref


def _split(spark: SparkSession, sf_dir: str):
    """The action cases that are compared inside their rows, and the rest."""
    return split_cases(store(action_cases(spark, sf_dir), "action-cases"), KEYS, fits_row(*LISTS))


def scored_pairs(spark: SparkSession, sf_dir: str, tau: float = THRESHOLD, mode: str = "max") -> DataFrame:
    """Candidate (generated, reference) pairs with both direction scores.

    ``mode="max"`` finds every pair whose two-way score can reach ``tau``;
    ``mode="min"`` every pair whose lexical overlap can."""
    own, rest = _split(spark, sf_dir)
    pairs = row_candidates(own, KEYS, *LISTS, tau, mode)
    if rest is not None:
        gen, ref = _exploded(rest)
        cand = overlap_candidates(gen, ref, KEYS, tau, mode=mode)
        pairs = pairs.unionByName(attach_texts(cand, gen, ref, KEYS, with_text=False))
    return token_pair_scores(pairs).withColumnsRenamed({"a": "g", "b": "r"})


def action_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + F9: within-case pairs whose lexical overlap reaches 0.5."""
    p = scored_pairs(spark, sf_dir, mode="min").filter(F.col("overlap") >= THRESHOLD)
    return truncate_floats(p.select(*KEYS, "g", "r", "overlap"), 6)


def bidirectional_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + J7: pairs whose two-way score reaches the threshold, labelled."""
    p = scored_pairs(spark, sf_dir, mode="max").filter(F.col("score") >= THRESHOLD)
    out = p.select(*KEYS, "g", "r", "forward", "backward", "score", similarity_label("score", THRESHOLD).alias("label"))
    return truncate_floats(out, 6)


def within_case_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + F10: every generated x reference pair of a case with its label,
    factored by classes of equal token sets; pairs without a common token as
    one counted row a case."""
    own, rest = _split(spark, sf_dir)
    pairs = row_case_pairs(own, KEYS, *LISTS, THRESHOLD)
    if rest is not None:
        pairs = pairs.unionByName(case_pairs(*_exploded(rest), KEYS, THRESHOLD))
    return truncate_floats(pairs, 6)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, rest = _split(spark, sf_dir)
    out = row_matches(own, THRESHOLD, *LISTS)
    if rest is not None:
        gen, ref = _exploded(rest)
        cand = overlap_candidates(gen, ref, KEYS, THRESHOLD, mode="max")  # the match score is two-way
        scored = token_pair_scores(attach_texts(cand, gen, ref, KEYS, with_text=False)).withColumnsRenamed({"a": "g", "b": "r"})
        out = out.unionByName(match_metrics(rest, greedy_pairs(scored, KEYS, THRESHOLD), KEYS))
    return out


def greedy_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    pairs_text = F.array_join(
        F.transform("matched_pairs", lambda p: F.concat_ws("=>", p["generated_action"], p["reference_action"])), " | "
    )
    out = m.select(
        *KEYS,
        "num_generated_actions",
        "num_reference_actions",
        "num_matched_actions",
        "action_precision",
        "action_recall",
        "action_f1",
        "exact_match",
        "average_match_score",
        pairs_text.alias("matched_pairs_text"),
    )
    return truncate_floats(out, 3)


def action_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return action_summary(matches(spark, sf_dir))


def diagnose_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).withColumn("raw_model_output", F.array_join("generated_actions", "\n"))
    d = diagnose(m)
    return d.select(*KEYS, "diagnostic_label", "diagnostic_summary", "matched_actions_text",
                    "missed_reference_actions_text", "hallucinated_actions_text")


def rescore_saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + J8 + A16: the matches saved with list cells as JSON text (the CSV
    form), read back, with every third reference action treated as removed
    by de-duplication, then re-scored on the diagnostics-only path."""
    m = matches(spark, sf_dir)
    kept_ref = F.filter("reference_actions", lambda x, i: i % 3 != 2)
    saved = m.select(
        *KEYS,
        F.to_json("generated_actions").alias("generated_actions"),
        F.to_json(kept_ref).alias("reference_actions"),
        F.to_json("matched_pairs").alias("matched_pairs"),
    )
    back = read_matched_pairs(read_predictions(saved, ["generated_actions", "reference_actions"]))
    r = rescore_saved(back)
    out = r.select(
        *KEYS,
        "num_matched_actions",
        "action_precision",
        "action_recall",
        "action_f1",
        "exact_match",
        "average_match_score",
        F.array_join("unmatched_generated_actions", " | ").alias("unmatched_generated_text"),
        F.array_join("unmatched_reference_actions", " | ").alias("unmatched_reference_text"),
    )
    return truncate_floats(out, 3)


def document_lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(F.col("doc_id"), F.posexplode("lines").alias("idx", "text"))
    return keep_first_distinct_rows(lines, ["doc_id"])


def semantic_dedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 over every line of every document (after W6)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    own, rest = split_cases(docs, ["doc_id"], fits_row("lines"))
    out = row_semantic_dedup(own, ["doc_id"], "lines", THRESHOLD)
    if rest is not None:
        out = out.unionByName(semantic_dedup(document_lines(rest), ["doc_id"], THRESHOLD))
    return out.select("doc_id", "idx", "status")


QUERIES = {
    "action_pairs": action_pairs,
    "bidirectional_similarity": bidirectional_similarity,
    "within_case_pairs": within_case_pairs,
    "greedy_match": greedy_match_table,
    "action_summary": action_summary_table,
    "diagnose": diagnose_table,
    "semantic_dedup": semantic_dedup_table,
    "rescore_saved": rescore_saved_table,
}


# -- DuckDB oracles -------------------------------------------------------------


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tok(x: str) -> str:
    n = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({n}, ' ')) END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _dedup(lst: str) -> str:
    cleaned = f"list_transform({lst}, lambda a: {_strip('a')})"
    return (
        f"list_filter({cleaned}, lambda x, i: {_norm('x')} <> '' AND "
        f"list_position(list_transform({cleaned}, lambda y: {_norm('y')}), {_norm('x')}) = i)"
    )


def _cov(p: str, h: str) -> str:
    return f"(CASE WHEN len({p}) = 0 OR len({h}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {h})) / len({h}) END)"


def _hd(key: str, pos: int) -> str:
    return f"(instr('0123456789abcdef', substr(md5({key}), {pos}, 1)) - 1)"


def _cases_sql() -> str:
    key = "case_id || ':' || model_name || ':' || CAST(i - 1 AS VARCHAR)"
    words = "string_split(s, ' ')"
    third = f"array_to_string({words}[1:greatest(CAST(ceil(len({words}) / 3) AS INTEGER), 1)], ' ')"
    minus_one = f"(CASE WHEN len({words}) <= 1 THEN '' ELSE array_to_string({words}[1:len({words}) - 1], ' ') END)"
    shortened = f"(CASE WHEN {_hd(key, 1)} < 4 THEN NULL WHEN {_hd(key, 1)} < 10 THEN {third} ELSE {minus_one} END)"
    return f"""
base AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS case_id, role AS case_kind,
    {_dedup("string_split_regex(text, '[.!?]\\s+|\\n')")} AS reference_actions
  FROM conversations
), cases AS (
  SELECT b.*, m.model_name,
    {_dedup(f"list_filter(list_transform(b.reference_actions, lambda s, i: {shortened}), lambda x: x IS NOT NULL)")} AS generated_actions
  FROM base b, (SELECT unnest(['judge_a', 'judge_b']) AS model_name) m
), g AS (
  SELECT case_id, model_name, unnest(generated_actions) AS text_a, generate_subscripts(generated_actions, 1) - 1 AS g FROM cases
), r AS (
  SELECT case_id, model_name, unnest(reference_actions) AS text_b, generate_subscripts(reference_actions, 1) - 1 AS r FROM cases
), pairs AS (
  SELECT g.case_id, g.model_name, g.g, r.r, g.text_a, r.text_b, {_tok('g.text_a')} AS ta, {_tok('r.text_b')} AS tb
  FROM g JOIN r ON g.case_id = r.case_id AND g.model_name = r.model_name
), scored AS (
  SELECT *, {_cov('ta', 'tb')} AS forward, {_cov('tb', 'ta')} AS backward,
    least({_cov('ta', 'tb')}, {_cov('tb', 'ta')}) AS score,
    (CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE len(list_intersect(ta, tb)) / least(len(ta), len(tb)) END) AS overlap
  FROM pairs
)"""


def _t6(x: str) -> str:
    return f"trunc({x} * 1000000.0) / 1000000.0"


def _t3(x: str) -> str:
    return f"trunc({x} * 1000.0) / 1000.0"


def _action_pairs_sql() -> str:
    return f"WITH {_cases_sql()} SELECT case_id, model_name, CAST(g AS INTEGER) AS g, CAST(r AS INTEGER) AS r, {_t6('overlap')} AS overlap FROM scored WHERE overlap >= {THRESHOLD}"


def _bidir_sql() -> str:
    return (
        f"WITH {_cases_sql()} SELECT case_id, model_name, CAST(g AS INTEGER) AS g, CAST(r AS INTEGER) AS r, {_t6('forward')} AS forward, {_t6('backward')} AS backward, "
        f"{_t6('score')} AS score, 'same' AS label FROM scored WHERE score >= {THRESHOLD}"
    )


def _case_pairs_sql() -> str:
    return f"""WITH {_cases_sql()}, linked AS (
  SELECT case_id, model_name, list_sort(ta) AS ca, list_sort(tb) AS cb, min(g) AS g, min(r) AS r, count(*) AS n_pairs, min(forward) AS forward, min(backward) AS backward, min(score) AS score
  FROM scored WHERE overlap > 0 GROUP BY ALL
), apart AS (
  SELECT case_id, model_name, count(*) AS n_pairs FROM scored WHERE overlap = 0 GROUP BY ALL
)
SELECT case_id, model_name, CAST(g AS INTEGER) AS g, CAST(r AS INTEGER) AS r, n_pairs, {_t6('forward')} AS forward, {_t6('backward')} AS backward, {_t6('score')} AS score,
  CASE WHEN score >= {THRESHOLD} THEN 'same' ELSE 'different' END AS label FROM linked
UNION ALL SELECT case_id, model_name, NULL, NULL, n_pairs, 0.0, 0.0, 0.0, 'different' FROM apart"""


def _match_sql() -> str:
    init = "{'ug': []::INTEGER[], 'ur': []::INTEGER[], 'm': []::STRUCT(g INTEGER, r INTEGER, score DOUBLE)[]}"
    step = (
        "lambda acc, e: CASE WHEN list_contains(acc.ug, e.g) OR list_contains(acc.ur, e.r) THEN acc "
        "ELSE {'ug': list_append(acc.ug, e.g), 'ur': list_append(acc.ur, e.r), "
        "'m': list_append(acc.m, {'g': e.g, 'r': e.r, 'score': e.score})} END"
    )
    return f"""WITH {_cases_sql()}, edges AS (
  SELECT case_id, model_name,
    list_sort(list({{'ns': -score, 'g': CAST(g AS INTEGER), 'r': CAST(r AS INTEGER), 'score': score}})) AS es
  FROM scored WHERE score >= {THRESHOLD} GROUP BY case_id, model_name
), folded AS (
  SELECT case_id, model_name, list_reduce(es, {step}, {init}).m AS m FROM edges
), joined AS (
  SELECT c.*, coalesce(f.m, []::STRUCT(g INTEGER, r INTEGER, score DOUBLE)[]) AS m FROM cases c
  LEFT JOIN folded f ON c.case_id = f.case_id AND c.model_name = f.model_name
), counted AS (
  SELECT *, len(generated_actions) AS ng, len(reference_actions) AS nr, len(m) AS n,
    list_sum(list_transform(m, lambda p: p.score)) AS s FROM joined
), metr AS (
  SELECT *,
    CASE WHEN ng = 0 AND nr = 0 THEN 1.0 WHEN ng = 0 OR nr = 0 THEN (CASE WHEN ng = 0 THEN 1.0 ELSE 0.0 END) ELSE n / ng END AS p,
    CASE WHEN ng = 0 AND nr = 0 THEN 1.0 WHEN ng = 0 OR nr = 0 THEN (CASE WHEN nr = 0 THEN 1.0 ELSE 0.0 END) ELSE n / nr END AS rc
  FROM counted
), final AS (
  SELECT *, CASE WHEN ng = 0 AND nr = 0 THEN 1.0 WHEN p + rc <> 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f1,
    CASE WHEN ng = 0 AND nr = 0 THEN 1 WHEN ng = 0 OR nr = 0 THEN 0 WHEN n = ng AND n = nr THEN 1 ELSE 0 END AS exact_match,
    CASE WHEN ng = 0 AND nr = 0 THEN 1.0 WHEN ng = 0 OR nr = 0 OR n = 0 THEN 0.0 ELSE s / n END AS avg_score,
    list_filter(list_transform(generated_actions, lambda x, i: CASE WHEN list_contains(list_transform(m, lambda q: q.g), i - 1) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS ug,
    list_filter(list_transform(reference_actions, lambda x, i: CASE WHEN list_contains(list_transform(m, lambda q: q.r), i - 1) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS ur
  FROM metr
)"""


def _greedy_sql() -> str:
    return _match_sql() + f"""
SELECT case_id, model_name, CAST(ng AS INTEGER) AS num_generated_actions, CAST(nr AS INTEGER) AS num_reference_actions,
  CAST(n AS BIGINT) AS num_matched_actions, {_t3('p')} AS action_precision, {_t3('rc')} AS action_recall,
  {_t3('f1')} AS action_f1, exact_match, {_t3('avg_score')} AS average_match_score,
  array_to_string(list_transform(m, lambda q: generated_actions[q.g + 1] || '=>' || reference_actions[q.r + 1]), ' | ') AS matched_pairs_text
FROM final
"""


def _summary_sql() -> str:
    r = lambda x: _t3(f"round({x}, 9)")
    cols = ", ".join([
        f"{r('avg(CAST(exact_match AS DOUBLE))')} AS case_accuracy",
        f"{r('avg(CAST(exact_match AS DOUBLE))')} AS exact_match_rate",
        f"{r('avg(p)')} AS mean_action_precision",
        f"{r('avg(rc)')} AS mean_action_recall",
        f"{r('avg(f1)')} AS mean_action_f1",
        f"{r('avg(avg_score)')} AS mean_match_score",
        f"{r('avg(CASE WHEN len(ug) = 0 THEN 1.0 ELSE 0.0 END)')} AS hallucination_free_rate",
        f"{r('avg(CASE WHEN len(ur) = 0 THEN 1.0 ELSE 0.0 END)')} AS full_recall_rate",
        f"{r('avg(CAST(ng AS DOUBLE))')} AS mean_generated_actions",
        f"{r('avg(CAST(nr AS DOUBLE))')} AS mean_reference_actions",
        "count(*) AS support",
    ])
    return _match_sql() + f"""
SELECT model_name,
  CASE WHEN grouping(case_kind) = 0 THEN coalesce(case_kind, 'nan')
       WHEN grouping(nr) = 0 THEN 'reference_actions_' || CAST(nr AS VARCHAR) ELSE 'overall' END AS slice_name,
  CASE WHEN grouping(case_kind) = 0 THEN 1 WHEN grouping(nr) = 0 THEN 2 ELSE 0 END AS slice_rank,
  {cols}
FROM final GROUP BY GROUPING SETS ((model_name), (model_name, case_kind), (model_name, nr))
"""


def _diagnose_sql() -> str:
    j = lambda x: f"array_to_string(list_filter(list_transform({x}, lambda a: {_strip('a')}), lambda a: a <> ''), ' | ')"
    mg = "list_transform(m, lambda q: generated_actions[q.g + 1])"
    issues = (
        "concat_ws('+', CASE WHEN ng = 0 THEN 'empty_output' END, "
        "CASE WHEN len(ur) > 0 THEN 'missed_reference_actions' END, "
        "CASE WHEN len(ug) > 0 THEN 'hallucinated_actions' END)"
    )
    summary = (
        "concat_ws('; ', CASE WHEN n > 0 THEN 'Matched ' || CAST(n AS VARCHAR) || ' of ' || CAST(nr AS VARCHAR) || "
        "' reference actions' ELSE 'Matched 0 reference actions' END, "
        f"CASE WHEN len(ur) > 0 THEN 'missed: ' || {j('ur')} END, "
        f"CASE WHEN len(ug) > 0 THEN 'extra: ' || {j('ug')} END, "
        f"CASE WHEN ng = 0 THEN '{'model returned no output'}' END)"
    )
    return _match_sql() + f"""
SELECT case_id, model_name,
  CASE WHEN exact_match = 1 THEN 'correct' WHEN {issues} = '' THEN 'partial_semantic_mismatch' ELSE {issues} END AS diagnostic_label,
  CASE WHEN exact_match = 1 THEN 'Prediction exactly matched the reference action set.' ELSE {summary} END AS diagnostic_summary,
  {j(mg)} AS matched_actions_text, {j('ur')} AS missed_reference_actions_text, {j('ug')} AS hallucinated_actions_text
FROM final
"""


def _semantic_dedup_sql() -> str:
    red = (
        f"(least({_cov('x.tok', 'k.tok')}, {_cov('k.tok', 'x.tok')}) >= {THRESHOLD} OR "
        f"((CASE WHEN len(k.tok) = 0 OR len(x.tok) = 0 THEN 0.0 ELSE len(list_intersect(k.tok, x.tok)) / least(len(k.tok), len(x.tok)) END) >= 0.5"
        f" AND greatest({_cov('x.tok', 'k.tok')}, {_cov('k.tok', 'x.tok')}) >= {THRESHOLD}))"
    )
    init = "{'kept': []::STRUCT(idx BIGINT, tok VARCHAR[])[], 'removed': []::BIGINT[]}"
    step = (
        f"lambda acc, x: CASE WHEN len(list_filter(acc.kept, lambda k: {red})) > 0 "
        "THEN {'kept': acc.kept, 'removed': list_append(acc.removed, x.idx)} "
        "ELSE {'kept': list_append(acc.kept, x), 'removed': acc.removed} END"
    )
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx
  FROM documents
), normed AS (
  SELECT doc_id, idx, line, {_norm('line')} AS n FROM lines
), firsts AS (
  SELECT doc_id, n, min(idx) AS idx FROM normed WHERE n <> '' GROUP BY doc_id, n
), items AS (
  SELECT f.doc_id, f.idx, {_tok('l.line')} AS tok FROM firsts f JOIN normed l ON f.doc_id = l.doc_id AND f.idx = l.idx
), per_doc AS (
  SELECT doc_id, list({{'idx': CAST(idx AS BIGINT), 'tok': tok}} ORDER BY idx) AS xs FROM items GROUP BY doc_id
), folded AS (
  SELECT doc_id, list_reduce(xs, {step}, {init}).removed AS removed FROM per_doc
)
SELECT i.doc_id, CAST(i.idx AS INTEGER) AS idx,
  CASE WHEN list_contains(f.removed, CAST(i.idx AS BIGINT)) THEN 'removed' ELSE 'kept' END AS status
FROM items i JOIN folded f ON i.doc_id = f.doc_id
"""


def _rescore_sql() -> str:
    return _match_sql() + f"""
, saved AS (
  SELECT case_id, model_name, generated_actions AS g,
    list_filter(reference_actions, lambda x, i: (i - 1) % 3 <> 2) AS r,
    list_transform(m, lambda q: {{'ga': generated_actions[q.g + 1], 'ra': reference_actions[q.r + 1], 's': q.score}}) AS mp
  FROM final
), kept AS (
  SELECT *, list_filter(mp, lambda p: list_contains(r, p.ra)) AS kp FROM saved
), cnt AS (
  SELECT *, len(kp) AS n, len(g) AS ng, len(r) AS nr,
    list_transform(kp, lambda p: p.ga) AS mg, list_transform(kp, lambda p: p.ra) AS mr FROM kept
), met AS (
  SELECT *, CASE WHEN ng <> 0 THEN n / ng ELSE 0.0 END AS p, CASE WHEN nr <> 0 THEN n / nr ELSE 0.0 END AS rc FROM cnt
)
SELECT case_id, model_name, CAST(n AS INTEGER) AS num_matched_actions, {_t3('p')} AS action_precision, {_t3('rc')} AS action_recall,
  {_t3('CASE WHEN p + rc <> 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END')} AS action_f1,
  CASE WHEN n = ng AND n = nr THEN 1 ELSE 0 END AS exact_match,
  {_t3('CASE WHEN n > 0 THEN list_sum(list_transform(kp, lambda q: q.s)) / n ELSE 0.0 END')} AS average_match_score,
  array_to_string(list_filter(g, lambda x: NOT list_contains(mg, x)), ' | ') AS unmatched_generated_text,
  array_to_string(list_filter(r, lambda x: NOT list_contains(mr, x)), ' | ') AS unmatched_reference_text
FROM met
"""


def oracles() -> dict[str, str]:
    return {
        "rescore_saved": _rescore_sql(),
        "action_pairs": _action_pairs_sql(),
        "bidirectional_similarity": _bidir_sql(),
        "within_case_pairs": _case_pairs_sql(),
        "greedy_match": _greedy_sql(),
        "action_summary": _summary_sql(),
        "diagnose": _diagnose_sql(),
        "semantic_dedup": _semantic_dedup_sql(),
    }
