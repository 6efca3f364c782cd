"""Prompt columns.

A template is plain text with ``{column}`` placeholders; it is compiled once
on the driver into a ``concat`` of literals and columns, so prompt text is
built inside the JVM for every row. Messages are ``array<struct<role,
content>>``; local models that take no system role get the system text
merged into the user message.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default templates (wording is a caller choice; these are short defaults).
QA_JUDGE_SYSTEM = (
    "Decide whether the answer contradicts established knowledge. Reply 0 if it is factual, "
    "1 if it is hallucinated, 2 if you are not sure."
)
QA_JUDGE_TEMPLATE = "Question: {question}\nAnswer: {answer}\n\nReply with 0, 1 or 2 only.\nJudgement:"
QA_JUDGE_KNOWLEDGE_TEMPLATE = "Knowledge: {knowledge}\n" + QA_JUDGE_TEMPLATE
GUIDELINE_JUDGE_TEMPLATE = (
    "Guideline: {guideline_title}\nRules:\n{rules_text}\n\nPatient:\n{patient_vignette}\n\n"
    "Proposed actions:\n{proposed_actions_text}\n\nReply 0 if the actions follow the rules, 1 if they violate them, 2 if unsure."
)
ACTION_TEMPLATE = (
    "Guideline: {guideline_title}\nRules:\n{rules_text}\n\nPatient:\n{patient_vignette}\n\n"
    'Return JSON only: {{"recommended_actions": ["action 1", "action 2"]}}'
)
GENERATION_TEMPLATE = (
    "#Question#: {question}\n\n#Knowledge#: {knowledge}\n\n#Ground truth answer#: {ground_truth}\n\n"
    "Return exactly:\n#Hallucinated Answer#: <answer>\n#Justification of Hallucinated answer#: <rationale>"
)
# Added to a prompt whose answer is to be improved.
REVISION_SUFFIX = "\n\nImprove on this previous attempt and keep the same two fields:\n"
# JSON-payload prompts: pass ``payload=F.to_json(F.struct(...))`` to render.
RULE_EXTRACTION_TEMPLATE = (
    "Turn the guideline text into rules. Return one JSON object with a \"rules\" list; each rule has "
    "scenario, activation_condition, recommendation_class, execute, source_statement.\n\nInput:\n{payload}"
)
VIGNETTE_TEMPLATE = (
    "Write one patient vignette that the listed rules apply to. Return JSON with patient_vignette, "
    "triggered_rule_ids, recommended_actions, rationale.\n\nInput:\n{payload}"
)
NEAR_MISS_TEMPLATE = (
    "Write near-miss variants of the case that look like it but should not trigger the cited rules. "
    "Return JSON with an \"examples\" list.\n\nInput:\n{payload}"
)
OPTION_JUDGE_TEMPLATE = (
    "Question: {question}\nOption 1: {option_1}\nOption 2: {option_2}\n\nWhich option is correct? Reply Option 1 or Option 2."
)


def render(template: str, **overrides) -> Column:
    """Compile ``template`` to one string column; ``{name}`` reads column
    ``name`` (or an override column), null fields print as empty text."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported in templates")
            c = overrides.get(field, F.col(f"`{field}`"))
            parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def revision_prompt(prompt: Column, previous: Column) -> Column:
    """P3 (revision): the prompt again, with the previous attempt or what a
    reviser made of it; without one, the prompt alone."""
    return F.when(F.coalesce(previous, F.lit("")) != "", F.concat(prompt, F.lit(REVISION_SUFFIX), previous)).otherwise(prompt)


def messages(user: Column, system: str | Column | None = None, merge_system: bool = False) -> Column:
    """Chat messages; ``merge_system`` puts the system text in front of the
    user text for models without a system role."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if system is None:
        return F.array(msg("user", user))
    sys_col = F.lit(system) if isinstance(system, str) else system
    if merge_system:
        return F.array(msg("user", F.concat(sys_col, F.lit("\n\n"), user)))
    return F.array(msg("system", sys_col), msg("user", user))


def build_prompts(
    df: DataFrame,
    template: str,
    system: str | None = None,
    merge_system: bool = False,
    prompt_col: str = "prompt",
    messages_col: str = "messages",
    **overrides,
) -> DataFrame:
    """Add the prompt text and its chat messages."""
    user = render(template, **overrides)
    return df.withColumn(prompt_col, user).withColumn(messages_col, messages(F.col(prompt_col), system, merge_system))
