"""Bindings of record operators over whole given tables: reply parsers on real
text, pair labels, knowledge and question records, log texts, diagnostics,
vignette replies, headers, rule positions and audit rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import guideline_reply_label, option_vote, qa_reply_label
from ..operators import prompts
from ..operators.cases import guideline_header, record_status, select_index_range
from ..operators.decisions import POLICY_VERSION, audit_log, decide
from ..operators.diagnostics import DIAGNOSTIC_COLUMNS, diagnose, diagnostic_projection
from ..operators.inference import attach_responses
from ..operators.matching import label_pairs, token_pair_scores
from ..operators.metrics import abstaining_binary_metrics, truncate_floats
from ..operators.rules import explode_rules, extraction_method_counts, vignettes_from_replies
from ..operators.sessions import FOLLOW_UP_SENTENCE, follow_up_prompt, query_text, question_from, variable_text
from ..operators.terms import distinct_sorted_terms, explode_terms, extract_mesh_terms, term_category_map
from ..session import table
from ..sources.qa import adapt_medqa, decode_legacy_knowledge, first_n, prepare_qa_items
from . import actions, decisions, generation, guidelines, judging
from .common import hex_digit, key_text, sql_hex_digit

THRESHOLD = actions.THRESHOLD


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), "role", F.coalesce("text", F.lit("")).alias("text"))


_TURNS_SQL = "(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS case_id, role, coalesce(text, '') AS text FROM conversations)"


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F3 on every whole turn as a reply."""
    return _turns(spark, sf_dir).select(
        "case_id", qa_reply_label("text").alias("qa_label"), guideline_reply_label("text").alias("guideline_label"), option_vote("text").alias("vote")
    )


def attached_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the reply that follows it, by key; turns
    without one stay, with a null reply and so the abstaining label."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cases = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("raw_output"))
    out = attach_responses(cases, replies, ["conv_id", "turn"], how="left")
    return out.select("conv_id", "turn", F.length("question").alias("question_chars"), "raw_output", guideline_reply_label("raw_output").alias("label"))


def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents by id."""
    return first_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 100, "doc_id")


def label_action_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 + J7 on given rows: each generated action with the reference action
    of its place, texts of any length."""
    cases = actions.action_cases(spark, sf_dir)
    zipped = F.arrays_zip(F.col("generated_actions").alias("text_a"), F.col("reference_actions").alias("text_b"))
    pairs = cases.select(*actions.KEYS, F.posexplode(zipped).alias("i", "p")).select(*actions.KEYS, "i", "p.text_a", "p.text_b")
    out = label_pairs(pairs, THRESHOLD, scorer=token_pair_scores)
    return truncate_floats(out.select(*actions.KEYS, "i", "forward", "backward", "score", "label"), 6)


def _label_pairs_sql() -> str:
    tok, cov = actions._tok, actions._cov
    return f"""WITH {actions._cases_sql()}, z AS (
  SELECT case_id, model_name, unnest(range(greatest(len(generated_actions), len(reference_actions)))) AS i, generated_actions AS ga, reference_actions AS ra FROM cases
), p AS (
  SELECT case_id, model_name, i, ga[i + 1] AS a, ra[i + 1] AS b, {tok('ga[i + 1]')} AS ta, {tok('ra[i + 1]')} AS tb FROM z
), s AS (
  SELECT *, CASE WHEN trim(coalesce(a, '')) = '' OR trim(coalesce(b, '')) = '' THEN 0.0 ELSE {cov('ta', 'tb')} END AS f,
    CASE WHEN trim(coalesce(a, '')) = '' OR trim(coalesce(b, '')) = '' THEN 0.0 ELSE {cov('tb', 'ta')} END AS w FROM p
)
SELECT case_id, model_name, CAST(i AS INTEGER) AS i, {actions._t6('f')} AS forward, {actions._t6('w')} AS backward, {actions._t6('least(f, w)')} AS score,
  CASE WHEN f IS NULL THEN 'unknown' WHEN least(f, w) >= {THRESHOLD} THEN 'same' ELSE 'different' END AS label FROM s
"""


def _repr(line: Column) -> Column:
    """A line as quoted in a list's text form."""
    slashed = F.replace(line, F.lit("\\"), F.lit("\\\\"))
    double = line.contains("'") & ~line.contains('"')
    single = F.concat(F.lit("'"), F.replace(slashed, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), slashed, F.lit('"'))).otherwise(single)


def knowledge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S3: documents' lines in the legacy text form, decoded again, as
    question records."""
    d = table(spark, sf_dir, "documents")
    lines = F.array_join(F.transform(F.split("text", "\n"), _repr), ", ")
    legacy = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{'contexts': ["), lines, F.lit("]}"))).otherwise(
        F.concat(F.lit("{'contexts': array(["), lines, F.lit("], dtype=object)}"))
    )
    rows = d.select(
        F.col("doc_id").cast("string").alias("Question"), decode_legacy_knowledge(legacy).alias("Knowledge"), F.col("lang").alias("Ground Truth"),
        F.col("source").alias("Hallucinated Answer"), F.lit("easy").alias("Difficulty Level"),
    )
    out = prepare_qa_items(rows)
    return out.select("question", F.array_join("knowledge", "|").alias("knowledge_text"), F.size("knowledge").alias("n_knowledge"), "ground_truth", "least_similar_answer", "final_difficulty_level")


def medqa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 with text and with struct outputs, over every turn."""
    t = _turns(spark, sf_dir)
    first = F.substring_index("text", ". ", 1)
    tag = F.when(hex_digit(F.col("case_id"), 1) < 8, "Correct").otherwise("draft")
    plain = t.select(
        F.concat(F.lit("plain "), "case_id").alias("input"), F.array("role", "text").alias("knowledge"),
        F.array(F.struct(first.alias("output"), F.lit("other").alias("tags")), F.struct(F.col("text").alias("output"), tag.alias("tags"))).alias("references"),
    )
    nested = t.select(
        F.struct(F.concat(F.lit("nested "), "case_id").alias("text"), F.col("text").alias("context")).alias("input"), F.lit(None).cast("string").alias("context"),
        F.array(
            F.struct(F.struct(first.alias("text")).alias("output"), F.array(F.lit("other")).alias("tags")),
            F.struct(F.struct(F.col("text").alias("text")).alias("output"), F.array(F.lit("x"), tag).alias("tags")),
        ).alias("references"),
    )
    return adapt_medqa(plain).unionByName(adapt_medqa(nested))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _medqa_sql() -> str:
    text, first = _strip("text"), _strip("split_part(text, '. ', 1)")
    answer = f"CASE WHEN {sql_hex_digit('case_id', 1)} < 8 THEN {text} ELSE coalesce(nullif({first}, ''), {text}) END"
    context = f"array_to_string(list_filter([{_strip('role')}, {text}], lambda x: x <> ''), chr(10))"
    return f"""
SELECT * FROM (
  SELECT 'plain ' || case_id AS question, {context} AS context, {answer} AS long_answer FROM {_TURNS_SQL}
  UNION ALL SELECT 'nested ' || case_id, {text}, {answer} FROM {_TURNS_SQL}
) WHERE long_answer <> ''
"""


def knowledge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + O3 over documents: their words as a record's term list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    quoted = F.concat(F.lit("{'contexts': ['x'],\n 'meshes': array(['"), F.array_join(_words(), "', '"), F.lit("'], dtype=object)}"))
    d = d.select("doc_id", extract_mesh_terms(quoted).alias("meshes"))  # a column, so it is made once
    return d.select("doc_id", "meshes", distinct_sorted_terms(F.replace("meshes", F.lit("; "), F.lit(" ; "))).alias("terms"))


def _words() -> Column:
    return F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"(\p{L}+)"), 1)


def term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 + A10: terms paired by place with categories (of every second
    document one fewer); the last row and place of a term wins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", _words().alias("w"))
    n = F.size("w") - F.col("doc_id") % 2
    cats = F.transform(F.slice("w", 1, F.greatest(n, F.lit(0)).cast("int")), lambda x, i: F.concat_ws("-", F.col("lang"), F.col("source"), (i % 7).cast("string")))
    rows = d.where(F.size("w") > 0).select("doc_id", F.array_join("w", "; ").alias("meshes"), cats.alias("categories"))
    mapped = term_category_map(rows, row_no="doc_id")
    used = explode_terms(rows, ["doc_id"], "meshes").groupBy("term").agg(F.count("*").alias("n"))
    return used.join(mapped, "term", "left")


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 over every turn as the trace and the variable of a log step."""
    t = _turns(spark, sf_dir)
    trace = F.concat(F.lit("head\nQuery: #Question#: "), "text", F.lit("\n\n#Answer#: a\n#Hallucinated Answer#: b\nResponse: done"))
    odd = hex_digit(F.col("case_id"), 1) < 4
    t = t.select("case_id", F.when(~odd, trace).otherwise(F.lit("no markers")).alias("trace"), F.concat(F.lit("<VARIABLE>\n"), "text", F.lit(" </VARIABLE>")).alias("prompt"), F.upper("role").alias("improved"))
    t = t.withColumn("initial_text", F.coalesce(query_text(F.col("trace")), variable_text(F.col("prompt"))))
    return t.select(
        "case_id", "initial_text", question_from([F.col("initial_text"), F.col("improved"), F.col("trace")]).alias("question"),
        follow_up_prompt(F.col("initial_text"), F.col("improved")).alias("follow_up"),
    )


def _log_texts_sql() -> str:
    odd = f"{sql_hex_digit('case_id', 1)} < 4"
    q = "regexp_extract(initial_text, '(?s)#Question#:\\s*(.*?)\\n\\n(?:#Knowledge#:|#Answer#:|#Ground truth answer#:|#Hallucinated Answer#:)', 1)"
    return f"""
WITH t AS (
  SELECT case_id, upper(role) AS improved, {odd} AS odd,
    CASE WHEN {odd} THEN {_strip('text')} ELSE '#Question#: ' || text || chr(10) || chr(10) || '#Answer#: a' || chr(10) || '#Hallucinated Answer#: b' END AS initial_text
  FROM {_TURNS_SQL}
)
SELECT case_id, initial_text, CASE WHEN NOT odd THEN nullif({_strip(q)}, '') END AS question,
  CASE WHEN NOT odd AND improved <> '' THEN split_part(initial_text, '#Hallucinated Answer#:', 1) || '#Hallucinated Answer#:' || '{FOLLOW_UP_SENTENCE}' || improved END AS follow_up
FROM t
"""


def diagnostics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12's published table, all 28 columns."""
    m = actions.matches(spark, sf_dir).withColumn("raw_model_output", F.array_join("generated_actions", "\n"))
    m = m.withColumns({"guideline_title": F.col("case_kind"), "patient_vignette": F.array_join("reference_actions", " ")})
    return truncate_floats(diagnostic_projection(diagnose(m)), 3)


def _diagnostics_sql() -> str:
    base = actions._diagnose_sql()
    head, _, tail = base.rpartition("SELECT case_id, model_name,")
    j = lambda x: f"array_to_string(list_filter(list_transform({x}, lambda a: {_strip('a')}), lambda a: a <> ''), ' | ')"
    t3 = actions._t3
    cols = {
        "guideline_id": "''", "guideline_title": "case_kind", "case_kind": "case_kind", "decision": "CASE WHEN exact_match = 1 THEN 'Correct' ELSE 'Incorrect' END",
        "action_precision": t3("p"), "action_recall": t3("rc"), "action_f1": t3("f1"), "average_match_score": t3("avg_score"),
        "num_generated_actions": "CAST(ng AS INTEGER)", "num_reference_actions": "CAST(nr AS INTEGER)", "num_matched_actions": "CAST(n AS BIGINT)",
        "num_unmatched_generated_actions": "CAST(len(ug) AS INTEGER)", "num_unmatched_reference_actions": "CAST(len(ur) AS INTEGER)",
        "original_reference_actions_text": "''", "reference_actions_text": j("reference_actions"), "redundant_reference_actions_text": "''",
        "generated_actions_text": j("generated_actions"),
        "matched_pairs_text": "array_to_string(list_transform(m, lambda q: generated_actions[q.g + 1] || ' => ' || reference_actions[q.r + 1] || ' (' || printf('%.3f', q.score) || ')'), ' | ')",
        "reference_rule_ids_text": "''", "patient_vignette": "array_to_string(reference_actions, ' ')", "raw_model_output": "array_to_string(generated_actions, chr(10))",
    }
    return f"{head}SELECT case_id, model_name, {', '.join(f'{v} AS {k}' for k, v in cols.items())},{tail}"


def vignette_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + F8 from reply text: JSON, JSON in prose or in a fence, or none."""
    t = _turns(spark, sf_dir)
    sents = F.split("text", r"[.!?]\s+|\n")
    body = F.to_json(F.struct(
        F.when(hex_digit(F.col("case_id"), 2) == 0, F.lit("  ")).otherwise(F.element_at(sents, 1)).alias("patient_vignette"),
        F.array(F.lit("R001"), F.lit("R009"), F.lit("R002"), F.lit("R001")).alias("triggered_rule_ids"), sents.alias("recommended_actions"), F.col("role").alias("rationale"),
    ))
    kind = hex_digit(F.col("case_id"), 1) % 4
    reply = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here: "), body, F.lit(" Done."))).when(kind == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("[1, 2]"))
    rules = F.array(*[F.struct(F.lit(x).alias("rule_id")) for x in ("R001", "R002")])
    out = vignettes_from_replies(t.select("case_id", reply.alias("reply"), rules.alias("rules")), "reply", "rules", fenced=True)
    v = F.col("vignette")
    return out.select(
        "case_id", v["patient_vignette"].alias("patient_vignette"), F.array_join(v["triggered_rule_ids"], ",").alias("rule_ids"),
        F.array_join(v["recommended_actions"], "|").alias("actions"), v["rationale"].alias("rationale"),
    )


def _vignette_sql() -> str:
    cleaned = f"list_filter(list_transform(string_split_regex(text, '[.!?]\\s+|\\n'), lambda a: {_strip('a')}), lambda a: a <> '')"
    first = _strip("string_split_regex(text, '[.!?]\\s+|\\n')[1]")
    ok = f"({sql_hex_digit('case_id', 1)} % 4 <> 3 AND {sql_hex_digit('case_id', 2)} <> 0 AND {first} <> '')"
    return f"""SELECT case_id, CASE WHEN {ok} THEN {first} END AS patient_vignette, CASE WHEN {ok} THEN 'R001,R002,R001' END AS rule_ids,
  CASE WHEN {ok} THEN array_to_string({cleaned}, '|') END AS actions, CASE WHEN {ok} THEN {_strip('role')} END AS rationale FROM {_TURNS_SQL}"""


def record_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, P7, P8 over documents as records (the range spans all ids)."""
    rec = guidelines.document_records(spark, sf_dir)
    rec = rec.select(
        F.struct(
            F.col("guideline.record_index").alias("record_index"), F.col("guideline.id").alias("id"),
            F.when(F.col("guideline.record_index") % 5 == 0, F.lit(" ")).otherwise(F.col("guideline.source")).alias("source"),
            F.when(F.col("guideline.record_index") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("guideline.title")).alias("title"), F.col("guideline.extraction_method").alias("extraction_method"),
        ).alias("guideline"),
        (F.col("guideline.record_index") % 3).cast("int").alias("n_actionable"), (F.col("source_case.patient_vignette") != "").alias("has_source"), F.size("challenging_examples").alias("n_generated"),
    )
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    h = select_index_range(rec, 0, top if top is not None else 0).select(guideline_header("guideline").alias("h"), record_status("n_actionable", "has_source", "n_generated").alias("status"))
    return h.select("h.record_index", "h.id", "h.source", "h.title", "h.extraction_method", "status")


def _headers_sql() -> str:
    base = "CAST(doc_id AS VARCHAR) || ':base'"
    return f"""SELECT doc_id AS record_index, 'doc-' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS source,
  CASE WHEN doc_id % 7 = 0 THEN 'Untitled guideline' ELSE lang END AS title, 'llm' AS extraction_method,
  CASE WHEN doc_id % 3 = 0 THEN 'skipped_no_actionable_rules' WHEN {sql_hex_digit(base, 1)} = 0 OR string_split(text, chr(10))[1] = '' THEN 'skipped_missing_source_case'
    WHEN len(string_split(text, chr(10))) > 1 THEN 'generated' ELSE 'empty_generation' END AS status FROM documents"""


def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 over documents as records: one rule per line that ends a sentence,
    records without one kept."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: x.endswith("."))
    rules = F.transform(lines, lambda x, i: F.struct(F.format_string("R%03d", i + 1).alias("rule_id"), x.alias("execute")))
    return explode_rules(d.select("doc_id", rules.alias("rules")), keys=("doc_id",))


_RECORD_RULES_SQL = """
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: ends_with(x, '.')) AS lines FROM documents),
r AS (SELECT doc_id, unnest(lines) AS execute, generate_subscripts(lines, 1) AS i FROM l)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS rule_pos, 'R' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS rule_id, execute FROM r
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM l WHERE len(lines) = 0 OR lines IS NULL
"""


def extraction_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 over documents as rule specs."""
    k = hex_digit(key_text(F.col("doc_id"), "m"), 1)
    method = F.when(k < 10, "llm").when(k < 13, "llm_no_valid_rules").otherwise("llm_failed")
    spec = F.struct(F.struct(method.alias("extraction_method")).alias("engine_metadata"))
    return extraction_method_counts(table(spark, sf_dir, "documents").select(spec.alias("rule_spec")))


def judge_metrics_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 per judge and case kind."""
    return abstaining_binary_metrics(judging.guideline_predictions(spark, sf_dir), ["model_name", "case_kind"])


def _judge_metrics_sql() -> str:
    c = judging._sql_metric_select()
    r = judging._sql_ratio_cols(c, all_zero=False)
    return judging._SQL_GUIDE_PRED + f"SELECT model_name, case_kind, {', '.join(f'{v} AS {k}' for k, v in r.items())}, count(*) AS support FROM preds GROUP BY model_name, case_kind"


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 over orders as patients; the time stamp is left out, and the
    snapshot is shown by two of its fields."""
    a = audit_log(decide(decisions.patients(spark, sf_dir), policy="specificity"))
    field = lambda f: F.get_json_object("input_snapshot", f"$.{f}").alias(f"snapshot_{f}")
    return a.select("patient_id", F.array_join("activated_rules", ",").alias("activated_rules"), "recommendation_class", "policy_version", field("clinical_scenario"), field("care_context"))


def _audit_sql() -> str:
    return f"""SELECT f.patient_id, activated_rules, recommendation_class, '{POLICY_VERSION}' AS policy_version,
  p.clinical_scenario AS snapshot_clinical_scenario, p.care_context AS snapshot_care_context
FROM ({decisions._fire_sql('specificity')}) f JOIN ({decisions._patients_sql()}) p USING (patient_id)"""


#: What fills the placeholders, in Spark and in DuckDB (null prints as empty).
_PROMPT_FIELDS = {
    "question": (lambda: F.col("text"), "text"), "answer": (lambda: F.concat(F.lit("A: "), "text"), "'A: ' || text"), "knowledge": (lambda: F.col("role"), "role"),
    "guideline_title": (lambda: F.nullif(F.col("role"), F.lit("user")), "nullif(role, 'user')"), "rules_text": (lambda: F.col("case_id"), "case_id"),
    "patient_vignette": (lambda: F.col("text"), "text"), "proposed_actions_text": (lambda: F.concat(F.lit("- "), "text"), "'- ' || text"),
    "ground_truth": (lambda: F.reverse("case_id"), "reverse(case_id)"), "payload": (lambda: F.concat(F.lit("["), "role", F.lit("]")), "'[' || role || ']'"),
    "option_1": (lambda: F.col("text"), "text"), "option_2": (lambda: F.concat("text", F.lit("?")), "text || '?'"),
}


def prompt_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template, and the revision of a generation prompt, over every
    turn."""
    t = _turns(spark, sf_dir)
    fields = {k: v[0]() for k, v in _PROMPT_FIELDS.items()}
    named = [F.struct(F.lit(n).alias("template"), prompts.render(text, **fields).alias("prompt")) for n, text in _templates().items()]
    again = prompts.revision_prompt(prompts.render(prompts.GENERATION_TEMPLATE, **fields), F.when(F.col("role") != "user", F.col("text")))
    named.append(F.struct(F.lit("revision").alias("template"), again.alias("prompt")))
    return t.select("case_id", F.explode(F.array(*named)).alias("p")).select("case_id", "p.template", "p.prompt")


def _templates() -> dict[str, str]:
    return {k.removesuffix("_TEMPLATE").lower(): v for k, v in vars(prompts).items() if k.endswith("_TEMPLATE")}


def _prompt_sql(template: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        parts += [quoted(literal)] if literal else []
        parts += [f"coalesce({_PROMPT_FIELDS[field][1]}, '')"] if field else []
    return " || ".join(parts)


def _prompt_set_sql() -> str:
    rows = [f"SELECT case_id, '{n}' AS template, {_prompt_sql(t)} AS prompt FROM {_TURNS_SQL}" for n, t in _templates().items()]
    base = _prompt_sql(prompts.GENERATION_TEMPLATE)
    rows.append(f"SELECT case_id, 'revision', CASE WHEN role <> 'user' AND text <> '' THEN {base} || '{prompts.REVISION_SUFFIX}' || text ELSE {base} END FROM {_TURNS_SQL}")
    return " UNION ALL ".join(rows)


QUERIES = {
    f.__name__: f
    for f in (
        text_labels, attached_replies, first_documents, label_action_pairs, knowledge_items, medqa_rows, knowledge_terms, term_map, log_texts, diagnostics_table, vignette_replies,
        record_headers, record_rules, extraction_methods, judge_metrics_by_kind, audit_rows, prompt_set,
    )
}
assert len(DIAGNOSTIC_COLUMNS) == 28

_LETTERS = "regexp_extract_all(coalesce(text, ''), '(\\p{L}+)', 1)"


def oracles() -> dict[str, str]:
    digit = sql_hex_digit("CAST(doc_id AS VARCHAR) || ':m'", 1)
    return {
        "text_labels": f"SELECT case_id, {judging._sql_qa_label('text')} AS qa_label, {judging._sql_guideline_label('text')} AS guideline_label, {generation._vote_sql('text')} AS vote FROM {_TURNS_SQL}",
        "attached_replies": f"SELECT c.conv_id, c.turn, length(c.text) AS question_chars, r.text AS raw_output, {judging._sql_guideline_label('r.text')} AS label FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user'",
        "first_documents": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100",
        "label_action_pairs": _label_pairs_sql(),
        "knowledge_items": "SELECT CAST(doc_id AS VARCHAR) AS question, coalesce(text, '') AS knowledge_text, 1 AS n_knowledge, lang AS ground_truth, source AS least_similar_answer, 'easy' AS final_difficulty_level FROM documents",
        "medqa_rows": _medqa_sql(),
        "knowledge_terms": f"SELECT doc_id, array_to_string({_LETTERS}, '; ') AS meshes, array_to_string(list_sort(list_distinct({_LETTERS})), '; ') AS terms FROM documents",
        "term_map": f"""
WITH w AS (SELECT doc_id, lang, source, {_LETTERS} AS w FROM documents),
t AS (SELECT doc_id, lang, source, len(w) AS n, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS i FROM w),
c AS (SELECT term, arg_max(concat_ws('-', lang, source, CAST(i % 7 AS VARCHAR)), (doc_id, i)) FILTER (WHERE i < n - doc_id % 2) AS category, count(*) AS n FROM t GROUP BY term)
SELECT term, n, category FROM c""",
        "log_texts": _log_texts_sql(),
        "diagnostics_table": _diagnostics_sql(),
        "vignette_replies": _vignette_sql(),
        "record_headers": _headers_sql(),
        "record_rules": _RECORD_RULES_SQL,
        "extraction_methods": f"SELECT CASE WHEN {digit} < 10 THEN 'llm' WHEN {digit} < 13 THEN 'llm_no_valid_rules' ELSE 'llm_failed' END AS extraction_method, count(*) AS count FROM documents GROUP BY 1",
        "judge_metrics_by_kind": _judge_metrics_sql(),
        "audit_rows": _audit_sql(),
        "prompt_set": _prompt_set_sql(),
    }
