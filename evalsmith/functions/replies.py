"""Parsers that turn free-text model replies into labels, votes and lists.

All parsers are Catalyst expressions over a reply column, so a reply table of
any size is parsed inside whole-stage codegen without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, py_strip

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's word lists for parity).
# QA judge reply words, tested in this order: hallucinated, then abstain.
QA_HALLUCINATED_WORDS = ["1", "not", "non"]
QA_ABSTAIN_WORDS = ["not sure", "pass", "skip", "2"]
# Guideline judge reply words, tested in this order after the first digit.
GUIDELINE_UNSURE_WORDS = ["unsure", "not sure", "cannot determine", "can't determine", "insufficient"]
GUIDELINE_VIOLATION_WORDS = ["violate", "discordant", "not supported", "incorrect"]
GUIDELINE_CONCORDANT_WORDS = ["concordant", "follow", "supported", "correct"]
# Keys that may hold an action list in a JSON reply, in priority order.
ACTION_LIST_KEYS = ["recommended_actions", "actions", "recommendations"]
# Section labels of a generated answer block.
ANSWER_SECTION_LABELS = [
    "Question",
    "Knowledge",
    "Ground truth answer",
    "Hallucinated Answer",
    "Justification of Hallucinated answer",
]
# A section block, the option a judge names, and a bare option number.
SECTION_PATTERN = r"(?s)#([^#]+)#:\s*(.*?)(?=\n\s*#[^#]+#:\s*|\z)"
OPTION_PATTERN = r"(?i)option\s*([12])\b"
BARE_OPTION_PATTERN = r"\b([12])\b"
# What is cut from a line that lists an action, in this order.
LINE_KEY_PATTERN = r"(?i)^recommended_actions\s*:\s*"
LINE_BULLET_PATTERN = r"^[-*•]+\s*"
LINE_NUMBER_PATTERN = r"^\d+[\).]\s*"
# ---------------------------------------------------------------------------


def _contains_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def qa_reply_label(reply, abstain_first: bool = False) -> Column:
    """1 = hallucinated, 2 = not sure, 0 = factual.

    Parity order tests the hallucinated words first, so "not sure" is 1
    (Q1). ``abstain_first=True`` tests the abstain words first.
    """
    t = F.lower(F.coalesce(col_of(reply), F.lit("")))
    hall = _contains_any(t, QA_HALLUCINATED_WORDS)
    abst = _contains_any(t, QA_ABSTAIN_WORDS)
    if abstain_first:
        return F.when(abst, 2).when(hall, 1).otherwise(0)
    return F.when(hall, 1).when(abst, 2).otherwise(0)


def guideline_reply_label(reply) -> Column:
    """first character among 0/1/2, else word lists, else 2 (abstain)."""
    t = F.lower(py_strip(F.coalesce(col_of(reply), F.lit(""))))
    digit = F.regexp_extract(t, "[012]", 0)
    return (
        F.when(digit != "", digit.cast("int"))
        .when(_contains_any(t, GUIDELINE_UNSURE_WORDS), 2)
        .when(_contains_any(t, GUIDELINE_VIOLATION_WORDS), 1)
        .when(_contains_any(t, GUIDELINE_CONCORDANT_WORDS), 0)
        .otherwise(2)
    )


def option_vote(reply) -> Column:
    """the option a judge picked: ``option 1/2`` first, else a bare 1/2."""
    r = col_of(reply)
    opt = F.regexp_extract(r, OPTION_PATTERN, 1)
    bare = F.regexp_extract(r, BARE_OPTION_PATTERN, 1)
    return F.coalesce(F.nullif(opt, F.lit("")), F.nullif(bare, F.lit("")))


def fooled(reply) -> Column:
    """A judge is fooled iff it picked option 2."""
    return F.coalesce(option_vote(reply) == "2", F.lit(False))


def answer_sections(text) -> Column:
    """``#Label#: body`` blocks to a struct of the 5 named sections.

    The last block with a label wins; a missing label gives "".
    """
    t = F.coalesce(col_of(text), F.lit(""))
    labels = F.regexp_extract_all(t, F.lit(SECTION_PATTERN), 1)
    bodies = F.regexp_extract_all(t, F.lit(SECTION_PATTERN), 2)
    pairs = F.zip_with(labels, bodies, lambda l, b: F.struct(l.alias("l"), b.alias("b")))
    fields = []
    def label_is(name):
        return lambda p: py_strip(p["l"]) == name

    for name in ANSWER_SECTION_LABELS:
        hits = F.filter(pairs, label_is(name))
        last = F.when(F.size(hits) > 0, py_strip(F.element_at(hits, -1)["b"])).otherwise(F.lit(""))
        fields.append(last.alias(name.lower().replace(" ", "_")))
    return F.struct(*fields)


# -- action lists -------------------------------------------------------------


def norm_action(c) -> Column:
    """Normalization used to compare actions: lower, non [a-z0-9] runs to one space."""
    x = F.regexp_replace(F.lower(col_of(c)), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def first_distinct_items(arr) -> Column:
    """W6 on an array: (place, first spelling) of what is left, as structs (i, v) in order."""
    # Sorted by normal form and place, the first of each form is told from the
    # item before it; each list is bound once by a one-element transform.
    items = F.array_sort(
        F.filter(
            F.transform(col_of(arr), lambda x, i: F.struct(norm_action(x).alias("n"), i.alias("i"), py_strip(x).alias("v"))),
            lambda s: s["n"] != "",
        )
    )

    def firsts(s):
        own = F.filter(s, lambda e, i: (i == 0) | (e["n"] != F.get(s, i - 1)["n"]))
        return F.array_sort(F.transform(own, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))

    return F.get(F.transform(F.array(items), firsts), F.lit(0))


def keep_first_distinct(arr) -> Column:
    """W6 on an array: drop blanks and repeats after normalization, keep first spelling (stripped)."""
    return F.transform(first_distinct_items(arr), lambda e: e["v"])


def _is_container(v: Column, allow_object: bool = True) -> Column:
    kind = F.upper(F.substring(F.schema_of_variant(v), 1, 6))
    cond = kind.startswith("ARRAY")
    if allow_object:
        cond = cond | kind.startswith("OBJECT")
    return F.coalesce(v.isNotNull() & cond, F.lit(False))


def json_payload(text) -> Column:
    """Whole text, else first '{' to last '}', else first '[' to last ']' (a list only).

    Parsed with ``try_parse_json`` (strict JSON, like Python's json module).
    """
    t = py_strip(F.coalesce(col_of(text), F.lit("")))
    # A candidate that starts with '{' / '[' and parses is an object / array,
    # so the container test needs no walk over the parsed value.
    starts_container = t.startswith("{") | t.startswith("[")
    whole = F.when(starts_container, F.try_parse_json(t))
    o1, o2 = F.instr(t, "{"), _last_index(t, "}")
    braces = F.when((o1 > 0) & (o2 > o1), F.try_parse_json(F.substring(t, o1, o2 - o1 + 1)))
    l1, l2 = F.instr(t, "["), _last_index(t, "]")
    brackets = F.when((l1 > 0) & (l2 > l1), F.try_parse_json(F.substring(t, l1, l2 - l1 + 1)))
    return F.coalesce(whole, braces, brackets)


def _last_index(t: Column, ch: str) -> Column:
    """1-based position of the last occurrence of ``ch`` (0 if absent)."""
    r = F.instr(F.reverse(t), ch)
    return F.when(r > 0, F.length(t) - r + 1).otherwise(0)


def _variant_items(v: Column) -> Column:
    """Items of a variant array as stripped text, blanks dropped; non-strings as JSON."""
    items = F.try_variant_get(v, "$", "array<variant>")
    as_text = F.transform(
        items,
        lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)),
    )
    return F.filter(F.transform(as_text, lambda s: py_strip(s)), lambda s: s != "")


def _payload_actions(payload: Column) -> Column:
    """(decided, actions) from a JSON payload, following the key order."""
    is_arr = F.try_variant_get(payload, "$", "array<variant>").isNotNull()
    result = None
    for key in reversed(ACTION_LIST_KEYS):
        val = F.try_variant_get(payload, f"$.{key}", "variant")
        is_list = F.try_variant_get(val, "$", "array<variant>").isNotNull()
        # only a JSON string counts as one action (not a number or object)
        is_text = F.coalesce(F.schema_of_variant(val) == "STRING", F.lit(False))
        as_str = py_strip(F.try_variant_get(val, "$", "string"))
        list_branch = F.struct(F.lit(True).alias("decided"), _variant_items(val).alias("actions"))
        str_branch = F.struct(F.lit(True).alias("decided"), F.array(as_str).alias("actions"))
        nxt = result if result is not None else F.struct(
            F.lit(False).alias("decided"), F.array().cast("array<string>").alias("actions")
        )
        result = (
            F.when(val.isNotNull() & is_list, list_branch)
            .when(val.isNotNull() & is_text & (as_str != ""), str_branch)
            .otherwise(nxt)
        )
    arr_branch = F.struct(F.lit(True).alias("decided"), _variant_items(payload).alias("actions"))
    none = F.struct(F.lit(False).alias("decided"), F.array().cast("array<string>").alias("actions"))
    return F.when(payload.isNull(), none).when(is_arr, arr_branch).otherwise(result)


# Python's str.splitlines() boundaries.
_LINE_SPLIT = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def action_lines(text) -> Column:
    """Bullet / numbered lines with markers and quotes stripped."""
    lines = F.split(F.coalesce(col_of(text), F.lit("")), _LINE_SPLIT)

    def clean(line):
        x = py_strip(line)
        x = F.regexp_replace(x, LINE_KEY_PATTERN, "")
        x = F.regexp_replace(x, LINE_BULLET_PATTERN, "")
        x = F.regexp_replace(x, LINE_NUMBER_PATTERN, "")
        x = py_strip(x)
        x = F.regexp_replace(x, r'^"+|"+$', "")
        x = F.regexp_replace(x, r"^'+|'+$", "")
        return py_strip(x)

    cleaned = F.transform(lines, clean)
    return F.filter(cleaned, lambda s: (s != "") & ~s.isin("[", "]", "{", "}"))


def parse_action_replies(df, reply: str, out: str = "actions", legacy_empty_list: bool = False):
    """F5 as a DataFrame operator: the JSON payload and the key lookup are
    staged as columns so each reply is parsed once (an expression used in
    several branches would be re-evaluated per branch)."""
    staged = df.withColumn("_payload", json_payload(F.col(reply)))
    staged = staged.withColumn("_parsed", _payload_actions(F.col("_payload")))
    use = F.size(F.col("_parsed.actions")) > 0 if legacy_empty_list else F.col("_parsed.decided")
    res = F.when(use, keep_first_distinct(F.col("_parsed.actions"))).otherwise(keep_first_distinct(action_lines(F.col(reply))))
    return staged.withColumn(out, res).drop("_payload", "_parsed")


def parse_action_reply(text, legacy_empty_list: bool = False) -> Column:
    """reply text to a de-duplicated action list.

    A JSON payload with a list (or one string) under the first present key
    wins; otherwise bullet / numbered lines. A payload whose list is empty is
    an empty list (Q4 corrected); ``legacy_empty_list=True`` falls through to
    the line parser as the reference does.
    """
    parsed = _payload_actions(json_payload(text))
    has_items = F.size(parsed["actions"]) > 0
    if legacy_empty_list:
        use_payload = has_items
    else:
        use_payload = parsed["decided"]
    return F.when(use_payload, keep_first_distinct(parsed["actions"])).otherwise(keep_first_distinct(action_lines(text)))


def parse_json_object(text, fenced: bool = False) -> Column:
    """a JSON object from a reply: whole text, else a fenced block
    (``fenced=True``), else the widest braces; null when none parses."""
    t = py_strip(F.coalesce(col_of(text), F.lit("")))

    def obj(x):
        v = F.try_parse_json(x)
        kind = F.upper(F.substring(F.schema_of_variant(v), 1, 6))
        return F.when(v.isNotNull() & (kind == "OBJECT"), v)

    cands = [obj(t)]
    if fenced:
        body = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
        cands.append(F.when(body != "", obj(body)))
    o1, o2 = F.instr(t, "{"), _last_index(t, "}")
    cands.append(F.when((o1 > 0) & (o2 > o1), obj(F.substring(t, o1, o2 - o1 + 1))))
    return F.coalesce(*cands)


def typed_fields(obj, fields: dict[str, str]) -> Column:
    """A struct of the named fields of a variant object: ``string`` fields as
    text (a missing or non-text one is null), ``array<string>`` fields as
    lists (a non-list is empty)."""
    v = col_of(obj)
    out = []
    for name, kind in fields.items():
        value = F.try_variant_get(v, f"$.{name}", kind)
        out.append((F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value).alias(name))
    return F.struct(*out)
