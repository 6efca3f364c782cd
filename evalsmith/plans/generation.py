"""Generation-round bindings.

Items are ``benchmark`` rows; judges' replies and attempts are md5-chosen.
The model stubs used by ``score_batches`` / ``refine_rounds`` are small,
deterministic pandas functions standing in for caller-supplied models.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import answer_sections, fooled, option_vote, parse_action_replies, qa_reply_label
from ..functions.similarity import coverage, cosine
from ..functions.text import tokens
from ..operators.generation import (
    any_fooled,
    difficulty_from_votes,
    final_answer,
    first_success,
    pending,
    widen_attempts,
)
from ..operators.inference import refine_rounds, score_batches
from ..operators.metrics import truncate_floats
from ..operators.joins import join_facts
from ..operators.prompts import QA_JUDGE_KNOWLEDGE_TEMPLATE, QA_JUDGE_SYSTEM, REVISION_SUFFIX, build_prompts
from ..session import table
from .common import hex_digit, key_text, pick, sql_hex_digit, sql_list

N_JUDGES = 3
N_ATTEMPTS = 5
VOTE_REPLIES = [
    "Option 1", "option 2", "I pick OPTION 2.", "2", "1", "Option 1 is right; option 2 is not", "neither", "option2",
    "Answer: 2", "12", "The second (2)", "", "Option 1.", "option 3", "2 or 1", "It is 1",
]
DIFFS = ["easy", "medium", "hard"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")


def _votes(item: F.Column) -> F.Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(N_JUDGES)),
        lambda j: F.struct(j.alias("judge"), pick(VOTE_REPLIES, hex_digit(key_text(item, j), 1)).alias("reply")),
    )


def option_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 per (item, judge)."""
    it = _items(spark, sf_dir)
    v = it.select("item_id", F.explode(_votes(F.col("item_id"))).alias("v"))
    return v.select("item_id", F.col("v.judge").alias("judge"), F.col("v.reply").alias("reply"),
                    option_vote(F.col("v.reply")).alias("vote"), fooled(F.col("v.reply")).alias("fooled"))


def difficulty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 + A13 from each item's judge votes (an array per item: no grouping)."""
    it = _items(spark, sf_dir)
    votes = F.transform(_votes(F.col("item_id")), lambda x: fooled(x["reply"]))
    return it.select(
        "item_id",
        F.size(F.filter(votes, lambda x: x)).alias("n_fooled"),
        any_fooled(votes).alias("any_fooled"),
        difficulty_from_votes(votes).alias("difficulty"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N_ATTEMPTS attempts per item: every attempt drops a different fifth of
    the words; similarity = token coverage of the truth by the attempt."""
    it = _items(spark, sf_dir)
    a = it.select("item_id", "text", F.explode(F.sequence(F.lit(1), F.lit(N_ATTEMPTS))).alias("attempt_no"))
    words = F.split(F.col("text"), " ")
    answer = F.array_join(F.filter(words, lambda w, i: (i % N_ATTEMPTS) != (F.col("attempt_no") - 1)), " ")
    k = key_text(F.col("item_id"), F.col("attempt_no"), "f")
    votes = F.transform(F.sequence(F.lit(1), F.lit(N_JUDGES)), lambda j: hex_digit(k, j) < 2)
    return a.select(
        "item_id",
        "attempt_no",
        answer.alias("answer"),
        F.concat(F.lit("because "), F.col("item_id")).alias("justification"),
        coverage(tokens(answer), tokens(F.col("text"))).alias("similarity"),
        votes.alias("_votes"),
    ).select(
        "*",
        any_fooled("_votes").alias("any_fooled"),
        difficulty_from_votes("_votes").alias("difficulty"),
        F.transform("_votes", lambda v: F.struct(v.alias("fooled"), F.when(v, F.lit("2")).otherwise(F.lit("1")).alias("reasoning"))).alias("votes"),
    ).drop("_votes")


def first_success_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = first_success(attempts(spark, sf_dir))
    return truncate_floats(w.select("item_id", "attempt_no", "any_fooled", "difficulty", "similarity"), 6)


def final_answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_answer(first_success(attempts(spark, sf_dir)))


def widen_attempts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen_attempts(attempts(spark, sf_dir), N_ATTEMPTS, N_JUDGES)


def answer_sections_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 over marker blocks built from each benchmark text (the last
    duplicate label wins; a missing label gives '')."""
    it = _items(spark, sf_dir)
    block = F.concat(
        F.lit("#Question#: What about item "), F.col("item_id"), F.lit("?\n\n#Knowledge#: "), F.col("text"),
        F.lit("\n#Hallucinated Answer#: draft "), F.col("item_id"),
        F.lit("\n#Justification of Hallucinated answer#:  because\nit reads well "),
        F.lit("\n  #Hallucinated Answer#: final "), F.col("item_id"), F.lit("\n"),
    )
    s = answer_sections(block)
    return it.select("item_id", s.alias("s")).select("item_id", "s.*")


def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each vector's cosine to its label's centroid. The centroid is an
    algebraic per-(label, dimension) average; no pair of vectors is formed."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cent = dims.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_c")).select(
        "label", F.transform("_c", lambda s: s["m"]).alias("centroid")
    )
    j = join_facts(e, cent, ["label"], F.col("vec_id"))
    return j.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("cosine"))


def closest_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4-style pick per label: the vector most similar to the centroid
    (ties: lowest id), one algebraic max_by per label."""
    c = cosine_to_centroid(spark, sf_dir)
    return c.groupBy("label").agg(
        F.max_by(F.col("vec_id"), F.struct(F.col("cosine"), -F.col("vec_id"))).alias("vec_id"),
        F.max("cosine").alias("cosine"),
    )


def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: documents not yet labelled (left anti join)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pending(docs, table(spark, sf_dir, "labels"), "doc_id")


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = _items(spark, sf_dir).select(
        "item_id",
        F.concat(F.lit("What does item "), F.col("item_id"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"),
        F.concat(F.lit("Source "), F.col("item_id")).alias("knowledge"),
    )
    return build_prompts(it, QA_JUDGE_KNOWLEDGE_TEMPLATE, system=QA_JUDGE_SYSTEM, merge_system=True)


def build_prompts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompt_table(spark, sf_dir)
    return p.select("item_id", "prompt", F.col("messages")[0]["content"].alias("message"), F.size("messages").alias("n_messages"))


def stub_judge(prompts: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in for a judge model: reply by prompt length."""
    n = prompts.iloc[:, 0].str.len()
    return n.mod(3).map({0: "1", 1: "0", 2: "not sure"})


def score_batches_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prompt_table(spark, sf_dir)
    out = score_batches(p, stub_judge, ["item_id"], ["prompt"], "raw_output").drop("error")
    return out.withColumn("predicted_label", qa_reply_label("raw_output"))


def _h(s: str) -> int:
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


def stub_generate(b: pd.DataFrame) -> pd.Series:
    """By the prompt's hash: nothing, a bare answer, or the two sections."""

    def one(prompt: str) -> str:
        h = _h(prompt)
        if h % 7 == 0:
            return ""
        answer = f"answer-{h % 97}"
        return answer if h % 5 == 0 else f"#Hallucinated Answer#: {answer}\n#Justification of Hallucinated answer#: reason {h % 13}"

    return b.iloc[:, 0].map(one)


def stub_revise(b: pd.DataFrame) -> pd.Series:
    return b["answer"] + "+r" + b["reasoning"].map(lambda r: str(_h(r) % 10))


def _stub_vote(salt: str):
    def judge(b: pd.DataFrame) -> pd.Series:
        return b.iloc[:, 0].map(lambda a: "Option 2" if _h(a + salt) % 4 == 0 else "Option 1")

    return judge


def refine_rounds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).select("item_id", F.col("text").alias("prompt"))
    att = refine_rounds(items, "item_id", stub_generate, [_stub_vote("a"), _stub_vote("b"), _stub_vote("c")], stub_revise, rounds=3)
    return att.select("item_id", "attempt_no", "stage", "answer", "justification", "any_fooled", "difficulty")


# -- action replies ---------------------------------------------------------------

SHAPES = 8


def action_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    case_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    sents = F.split(F.col("text"), r"[.!?]\s+|\n")
    first = F.element_at(sents, 1)
    shape = hex_digit(case_id, 1) % SHAPES
    shape = F.when((shape == 3) & (F.trim(first) == ""), F.lit(0)).otherwise(shape)
    as_obj = F.to_json(F.struct(sents.alias("recommended_actions")))
    reply = (
        F.when(shape == 0, as_obj)
        .when(shape == 1, F.concat(F.lit("Here you go: "), as_obj, F.lit(" Thanks.")))
        .when(shape == 2, F.to_json(sents))
        .when(shape == 3, F.to_json(F.struct(first.alias("actions"))))
        .when(shape == 4, F.array_join(F.transform(sents, lambda s: F.concat(F.lit("- "), s)), "\n"))
        .when(shape == 5, F.array_join(F.transform(sents, lambda s, i: F.concat((i + 1).cast("string"), F.lit(") "), s)), "\n"))
        .when(shape == 6, F.lit('{"recommended_actions": []}'))
        .otherwise(F.lit(""))
    )
    return c.select(case_id.alias("case_id"), shape.alias("shape"), reply.alias("reply"))


def parse_action_replies_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = parse_action_replies(action_replies(spark, sf_dir), "reply", "acts")
    return r.select("case_id", "shape", F.array_join("acts", " | ").alias("actions_text"), F.size("acts").alias("n_actions"))


QUERIES = {
    "option_votes": option_votes,
    "difficulty": difficulty_table,
    "first_success": first_success_table,
    "final_answer": final_answer_table,
    "widen_attempts": widen_attempts_table,
    "answer_sections": answer_sections_table,
    "cosine_to_centroid": cosine_to_centroid,
    "closest_to_centroid": closest_to_centroid,
    "pending_items": pending_items,
    "build_prompts": build_prompts_table,
    "score_batches": score_batches_table,
    "refine_rounds": refine_rounds_table,
    "parse_action_replies": parse_action_replies_table,
}


# -- DuckDB oracles -------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _vote_sql(x: str) -> str:
    opt = f"regexp_extract({x}, '(?i)option\\s*([12])\\b', 1)"
    bare = f"regexp_extract({x}, '\\b([12])\\b', 1)"
    return f"coalesce(nullif({opt}, ''), nullif({bare}, ''))"


_VOTES_SQL = f"""
WITH v AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, j AS judge,
    {sql_list(VOTE_REPLIES)}[{sql_hex_digit("CAST(item_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)", 1)} + 1] AS reply
  FROM benchmark, (SELECT unnest(range(1, {N_JUDGES + 1})) AS j) js
)"""


def _option_votes_sql() -> str:
    return _VOTES_SQL + f" SELECT item_id, CAST(judge AS INTEGER) AS judge, reply, {_vote_sql('reply')} AS vote, coalesce({_vote_sql('reply')} = '2', false) AS fooled FROM v"


def _difficulty_sql() -> str:
    return _VOTES_SQL + f"""
, f AS (SELECT item_id, count_if(coalesce({_vote_sql('reply')} = '2', false)) AS n FROM v GROUP BY item_id)
SELECT item_id, CAST(n AS INTEGER) AS n_fooled, n > 0 AS any_fooled,
  CASE WHEN n = {N_JUDGES} THEN 'hard' WHEN n > 1 THEN 'medium' ELSE 'easy' END AS difficulty
FROM f
"""


def _tok(x: str) -> str:
    n = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE list_distinct(string_split({n}, ' ')) END)"


def _cov(p: str, h: str) -> str:
    return f"(CASE WHEN len({p}) = 0 OR len({h}) = 0 THEN 0.0 ELSE len(list_intersect({p}, {h})) / len({h}) END)"


_ATTEMPTS_SQL = f"""
WITH a AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, text, k AS attempt_no
  FROM benchmark, (SELECT unnest(range(1, {N_ATTEMPTS + 1})) AS k) ks
), b AS (
  SELECT *, array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % {N_ATTEMPTS} <> attempt_no - 1), ' ') AS answer,
    item_id || ':' || CAST(attempt_no AS VARCHAR) || ':f' AS k
  FROM a
), c AS (
  SELECT *, ({sql_hex_digit('k', 1)} < 2)::INT + ({sql_hex_digit('k', 2)} < 2)::INT + ({sql_hex_digit('k', 3)} < 2)::INT AS nf,
    {_cov(_tok('answer'), _tok('text'))} AS similarity
  FROM b
), d AS (
  SELECT *, nf > 0 AS any_fooled,
    CASE WHEN nf = {N_JUDGES} THEN 'hard' WHEN nf > 1 THEN 'medium' ELSE 'easy' END AS difficulty,
    min(CASE WHEN nf > 0 THEN attempt_no END) OVER (PARTITION BY item_id) AS first_ok
  FROM c
), kept AS (SELECT * FROM d WHERE first_ok IS NULL OR attempt_no <= first_ok)"""


def _first_success_sql() -> str:
    return _ATTEMPTS_SQL + " SELECT item_id, CAST(attempt_no AS INTEGER) AS attempt_no, any_fooled, difficulty, trunc(similarity * 1000000.0) / 1000000.0 AS similarity FROM kept"


def _final_answer_sql() -> str:
    return _ATTEMPTS_SQL + """
, g AS (
  SELECT item_id, max(CAST(any_fooled AS INT)) AS ok, count(*) AS attempts,
    arg_min({'a': answer, 'd': difficulty, 'n': attempt_no}, attempt_no) FILTER (WHERE any_fooled) AS fst,
    arg_max({'a': answer, 'd': difficulty, 'n': attempt_no}, (similarity, -attempt_no)) FILTER (WHERE coalesce(answer, '') <> '') AS best
  FROM kept GROUP BY item_id
)
SELECT item_id,
  CASE WHEN ok = 1 THEN fst.a ELSE best.a END AS least_similar_answer,
  CASE WHEN ok = 1 THEN fst.d ELSE best.d END AS final_difficulty_level,
  CAST(CASE WHEN ok = 1 THEN fst.n ELSE best.n END AS INTEGER) AS chosen_attempt,
  ok = 1 AS succeeded, attempts
FROM g
"""


def _widen_sql() -> str:
    cols = []
    for i in range(1, N_ATTEMPTS + 1):
        w = f"attempt_no = {i}"
        cols.append(f"max(CASE WHEN {w} THEN answer END) AS hallucinated_answer_{i}")
        cols.append(f"max(CASE WHEN {w} THEN 'because ' || item_id END) AS justification_{i}")
        for j in range(1, N_JUDGES + 1):
            f = f"({sql_hex_digit('k', j)} < 2)"
            cols.append(f"bool_or(CASE WHEN {w} THEN {f} END) AS fooled_discriminator_{j}_{i}")
            cols.append(f"max(CASE WHEN {w} THEN (CASE WHEN {f} THEN '2' ELSE '1' END) END) AS discriminator_reasoning_{j}_{i}")
        cols.append(f"max(CASE WHEN {w} THEN difficulty END) AS difficulty_level_{i}")
    return _ATTEMPTS_SQL + f" SELECT item_id, {', '.join(cols)} FROM d GROUP BY item_id"


def _sections_sql() -> str:
    return """
SELECT CAST(item_id AS VARCHAR) AS item_id,
  'What about item ' || CAST(item_id AS VARCHAR) || '?' AS question,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS knowledge,
  '' AS ground_truth_answer,
  'final ' || CAST(item_id AS VARCHAR) AS hallucinated_answer,
  'because' || chr(10) || 'it reads well' AS justification_of_hallucinated_answer
FROM benchmark
"""


_CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), d AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e
), m AS (SELECT label, p, avg(x) AS m FROM d GROUP BY label, p
), c AS (SELECT label, list(m ORDER BY p) AS c FROM m GROUP BY label
), j AS (
  SELECT e.vec_id, e.label, e.v, c.c,
    list_sum(list_transform(list_zip(e.v, c.c), lambda t: t[1] * t[2])) AS dot,
    sqrt(list_sum(list_transform(e.v, lambda t: t * t))) AS nv,
    sqrt(list_sum(list_transform(c.c, lambda t: t * t))) AS nc
  FROM e JOIN c ON e.label = c.label
), cs AS (
  SELECT vec_id, label, round(CASE WHEN nv = 0 OR nc = 0 THEN 0.0 ELSE dot / (nv * nc) END, 6) AS cosine FROM j
)"""


def _parse_replies_sql() -> str:
    case_id = "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)"
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    norm = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"

    def dedup(lst: str) -> str:
        cleaned = f"list_filter(list_transform({lst}, lambda a: {strip('a')}), lambda a: a <> '')"
        return (
            f"list_filter({cleaned}, lambda x, i: {norm('x')} <> '' AND "
            f"list_position(list_transform({cleaned}, lambda y: {norm('y')}), {norm('x')}) = i)"
        )

    def clean_line(x: str) -> str:
        y = strip(x)
        y = f"regexp_replace({y}, '(?i)^recommended_actions\\s*:\\s*', '')"
        y = f"regexp_replace({y}, '^[-*•]+\\s*', '')"
        y = f"regexp_replace({y}, '^\\d+[\\).]\\s*', '')"
        y = strip(y)
        y = f"regexp_replace({y}, '^\"+|\"+$', '', 'g')"
        y = f"regexp_replace({y}, '^''+|''+$', '', 'g')"
        return strip(y)

    bullets = f"list_filter(list_transform(sents, lambda s: {clean_line(chr(39) + '- ' + chr(39) + ' || s')}), lambda a: a NOT IN ('[', ']', '{{', '}}'))"
    numbered = f"list_filter(list_transform(sents, lambda s, i: {clean_line('CAST(i AS VARCHAR) || chr(41) || chr(32) || s')}), lambda a: a NOT IN ('[', ']', '{{', '}}'))"
    return f"""
WITH c AS (
  SELECT {case_id} AS case_id, string_split_regex(text, '[.!?]\\s+|\\n') AS sents FROM conversations
), s AS (
  SELECT *, CASE WHEN {sql_hex_digit('case_id', 1)} % {SHAPES} = 3 AND trim(sents[1]) = '' THEN 0
    ELSE {sql_hex_digit('case_id', 1)} % {SHAPES} END AS shape FROM c
), a AS (
  SELECT case_id, shape,
    CASE WHEN shape IN (0, 1, 2) THEN {dedup('sents')}
         WHEN shape = 3 THEN {dedup('[sents[1]]')}
         WHEN shape = 4 THEN {dedup(bullets)}
         WHEN shape = 5 THEN {dedup(numbered)}
         ELSE []::VARCHAR[] END AS acts
  FROM s
)
SELECT case_id, CAST(shape AS INTEGER) AS shape, array_to_string(acts, ' | ') AS actions_text, CAST(len(acts) AS INTEGER) AS n_actions FROM a
"""


def _build_prompts_sql() -> str:

    t = QA_JUDGE_KNOWLEDGE_TEMPLATE
    t = t.replace("{knowledge}", "' || knowledge || '").replace("{question}", "' || question || '").replace("{answer}", "' || answer || '")
    lit = "'" + t.replace("\n", "' || chr(10) || '") + "'"
    sys_lit = _q(QA_JUDGE_SYSTEM)
    return f"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, 'What does item ' || CAST(item_id AS VARCHAR) || ' say?' AS question,
    text AS answer, 'Source ' || CAST(item_id AS VARCHAR) AS knowledge FROM benchmark
), p AS (SELECT item_id, {lit} AS prompt FROM it)
SELECT item_id, prompt, {sys_lit} || chr(10) || chr(10) || prompt AS message, 1 AS n_messages FROM p
"""


def _score_batches_sql() -> str:
    return _build_prompts_sql().replace(
        "SELECT item_id, prompt, ", "SELECT item_id, CASE length(prompt) % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE 'not sure' END AS raw_output, "
    ).replace(" AS message, 1 AS n_messages FROM p", " AS message FROM p").replace(
        "SELECT item_id, CASE", "SELECT * EXCLUDE (message), CASE WHEN raw_output = '0' THEN 0 ELSE 1 END AS predicted_label FROM (SELECT item_id, CASE", 1
    ) + ")"


def _refine_rounds_sql(rounds: int = 3) -> str:
    """The stub models restated in SQL. They are pure, so an item's rows of a
    later round equal those of the first."""
    h = lambda x: f"(('0x' || substr(md5({x}), 1, 8))::BIGINT)"
    revision = REVISION_SUFFIX.replace("\n", "' || chr(10) || '")

    def stage(name: str, prompt: str, source: str) -> str:
        fooled = [f"CAST({h(f'answer || {salt!r}')} % 4 = 0 AS INTEGER)" for salt in ("a", "b", "c")]
        return f"""{name} AS (
  SELECT *, n > 0 AS any_fooled, CASE WHEN n = 3 THEN 'hard' WHEN n > 1 THEN 'medium' ELSE 'easy' END AS difficulty FROM (
    SELECT *, {' + '.join(fooled)} AS n FROM (
      SELECT item_id, text, 'answer-' || CAST(hash % 97 AS VARCHAR) AS answer, CASE WHEN hash % 5 = 0 THEN '' ELSE 'reason ' || CAST(hash % 13 AS VARCHAR) END AS justification
      FROM (SELECT item_id, text, {h(prompt)} AS hash FROM {source}) WHERE hash % 7 <> 0)))"""

    reasons = "'Option 1Reasons: Option 1Reasons: Option 1'"
    feedback = f"answer || '+r' || CAST({h(reasons)} % 10 AS VARCHAR)"
    ctes = [
        stage("g", "text", "(SELECT CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark)"),
        stage("r", f"text || '{revision}' || {feedback}", "(SELECT * FROM g WHERE NOT any_fooled)"),
        "s AS (SELECT item_id FROM g WHERE any_fooled UNION SELECT item_id FROM r WHERE any_fooled)",
    ]
    rows = []
    for rnd in range(1, rounds + 1):
        where = "" if rnd == 1 else " WHERE item_id NOT IN (SELECT item_id FROM s)"
        for n, (t, name) in enumerate((("g", "generate"), ("r", "revise"))):
            rows.append(f"SELECT item_id, {2 * rnd - 1 + n} AS attempt_no, '{name}' AS stage, answer, justification, any_fooled, difficulty FROM {t}{where}")
    return "WITH " + ", ".join(ctes) + "\n" + "\nUNION ALL\n".join(rows)


def oracles() -> dict[str, str]:
    return {
        "refine_rounds": _refine_rounds_sql(),
        "option_votes": _option_votes_sql(),
        "difficulty": _difficulty_sql(),
        "first_success": _first_success_sql(),
        "final_answer": _final_answer_sql(),
        "widen_attempts": _widen_sql(),
        "answer_sections": _sections_sql(),
        "cosine_to_centroid": _CENTROID_SQL + " SELECT * FROM cs",
        "closest_to_centroid": _CENTROID_SQL + " SELECT label, arg_max(vec_id, (cosine, -vec_id)) AS vec_id, max(cosine) AS cosine FROM cs GROUP BY label",
        "pending_items": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "build_prompts": _build_prompts_sql(),
        "score_batches": _score_batches_sql(),
        "parse_action_replies": _parse_replies_sql(),
    }
