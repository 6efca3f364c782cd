"""QA item and guideline-text adapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, col_of, normalize_ws, py_strip

# Published QA column names and their canonical names.
QA_COLUMN_MAP = {
    "Question": "question",
    "Knowledge": "knowledge",
    "Ground Truth": "ground_truth",
    "Hallucinated Answer": "least_similar_answer",
    "Difficulty Level": "final_difficulty_level",
}
QA_REQUIRED = ["question", "knowledge", "ground_truth", "least_similar_answer", "final_difficulty_level"]
# Context fields, in the order they are tried.
CONTEXT_FIELDS = ["context", "knowledge", "evidence", "support", "explanation", "rationale"]
INPUT_CONTEXT_FIELDS = ["context", "knowledge", "evidence", "support"]
# Preferred guideline text fields, in order.
GUIDELINE_TEXT_FIELDS = ["guideline", "text", "content", "body", "recommendation", "recommendations"]


def prepare_qa_items(df: DataFrame) -> DataFrame:
    """S3: rename published columns, check the required ones (P1),
    normalize knowledge to an array of text (null -> [], scalar -> [x]),
    project the five columns."""
    out = df.withColumnsRenamed({k: v for k, v in QA_COLUMN_MAP.items() if k in df.columns})
    missing = [c for c in QA_REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    kt = out.schema["knowledge"].dataType
    if isinstance(kt, T.ArrayType):
        know = F.coalesce(F.transform(F.col("knowledge"), lambda x: x.cast("string")), F.array().cast("array<string>"))
    else:
        know = F.when(F.col("knowledge").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("knowledge").cast("string")))
    return out.select(
        F.col("question"), know.alias("knowledge"), F.col("ground_truth"), F.col("least_similar_answer"), F.col("final_difficulty_level")
    )


# Unrolled: a repeated alternative would recurse once per character in Java.
_QUOTED = r"""('[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*")"""


def _unquote(item: Column) -> Column:
    body = F.substring(item, 2, F.length(item) - 2)
    body = F.regexp_replace(body, r"\\n", "\n")
    body = F.regexp_replace(body, r"\\t", "\t")
    body = F.regexp_replace(body, r"\\(['\"])", "$1")
    return F.regexp_replace(body, r"\\\\", "\\\\")


def decode_legacy_knowledge(c) -> Column:
    """Legacy knowledge text ``{'contexts': [...]}`` or
    ``{'contexts': array([...], dtype=object)}`` to newline-joined text;
    text that is not such a dict passes through; null gives ""."""
    x = col_of(c)
    pat = r"(?s)^\s*\{'contexts':\s*(?:array\()?\[(.*)\](?:,\s*dtype=[^)]*\))?\s*\}\s*$"
    body = F.regexp_extract(x, pat, 1)
    items = F.regexp_extract_all(body, F.lit(_QUOTED), 1)
    joined = F.array_join(F.transform(items, _unquote), "\n")
    # {'contexts': 'one text'}: the value itself
    single = r"(?s)^\s*\{'contexts':\s*" + _QUOTED + r"\s*\}\s*$"
    one = _unquote(F.regexp_extract(x, single, 1))
    return F.when(x.isNull(), F.lit("")).when(x.rlike(pat), joined).when(x.rlike(single), one).otherwise(x)


def _text_of(c: Column, dt: T.DataType) -> Column:
    """A value that is text, or a struct with ``text``, or a list of those."""
    if isinstance(dt, T.StructType):
        return py_strip(c["text"]) if "text" in dt.fieldNames() else F.lit("")
    if isinstance(dt, T.ArrayType):
        et = dt.elementType
        inner = (lambda e: py_strip(e["text"])) if isinstance(et, T.StructType) else (lambda e: py_strip(e.cast("string")))
        return F.array_join(F.filter(F.transform(c, inner), lambda s: s != ""), "\n")
    if isinstance(dt, T.VariantType):
        s = F.coalesce(F.try_variant_get(c, "$.text", "string"), F.try_variant_get(c, "$", "string"))
        arr = F.try_variant_get(c, "$", "array<string>")
        joined = F.array_join(F.filter(F.transform(arr, lambda e: py_strip(e)), lambda e: e != ""), "\n")
        return F.coalesce(F.when(arr.isNotNull(), joined), py_strip(s))
    return py_strip(c.cast("string"))


def first_n(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """The first ``n`` rows by ``order_col``. The order is explicit, as
    Spark has no input order; the limit runs per partition first."""
    return df.orderBy(order_col).limit(n)


def _reference_outputs(refs: T.ArrayType) -> Column:
    """(output text, tagged correct) of each reference; ``output`` is text or
    a struct with ``text``, ``tags`` a list or one text."""
    names = refs.elementType.fieldNames()
    output = refs.elementType["output"].dataType if "output" in names else None
    tags = refs.elementType["tags"].dataType if "tags" in names else None

    def one(r: Column) -> Column:
        text = F.coalesce(_text_of(r["output"], output), F.lit("")) if output else F.lit("")
        if isinstance(tags, T.ArrayType):
            correct = F.exists(F.coalesce(r["tags"], F.array()), lambda t: F.coalesce(F.lower(t) == "correct", F.lit(False)))
        else:
            correct = F.coalesce(F.lower(r["tags"].cast("string")) == "correct", F.lit(False)) if tags else F.lit(False)
        return F.struct(text.alias("t"), correct.alias("ok"))

    return F.transform(F.coalesce(F.col("references"), F.array()), one)


def adapt_medqa(df: DataFrame, split: str | None = None, limit: int | None = None, order_col: str | None = None, require_rows: bool = False) -> DataFrame:
    """MedQA-style rows to (question, context, long_answer).

    Question is ``input`` or ``input.text``; context is the first non-empty
    of the top-level then ``input.*`` context fields (lists newline-joined);
    the answer is the output of the first reference tagged ``correct``
    (case-insensitive), else the first non-empty output. Rows without a
    question or answer are dropped; ``limit`` keeps the first N by
    ``order_col``. ``require_rows`` raises when nothing is left (one probe,
    which reads at most one row).
    """
    d = df.filter(F.col("split") == split) if split and "split" in df.columns else df
    sch = d.schema
    q = _text_of(F.col("input"), sch["input"].dataType) if "input" in sch.fieldNames() else F.lit("")
    cands = [_text_of(F.col(f), sch[f].dataType) for f in CONTEXT_FIELDS if f in sch.fieldNames()]
    if "input" in sch.fieldNames() and isinstance(sch["input"].dataType, T.StructType):
        inner = sch["input"].dataType
        cands += [_text_of(F.col("input")[f], inner[f].dataType) for f in INPUT_CONTEXT_FIELDS if f in inner.fieldNames()]
    context = F.coalesce(*[F.when(c != "", c) for c in cands], F.lit("")) if cands else F.lit("")
    outputs = F.col("_outputs")
    tagged = F.try_element_at(F.filter(outputs, lambda o: o["ok"]), F.lit(1))["t"]
    nonempty = F.try_element_at(F.filter(outputs, lambda o: o["t"] != ""), F.lit(1))["t"]
    order = [order_col] if order_col else []
    out = d.select(*order, q.alias("question"), context.alias("context"), _reference_outputs(sch["references"].dataType).alias("_outputs"))
    out = out.select(*order, "question", "context", F.coalesce(tagged, nonempty, F.lit("")).alias("long_answer"))
    out = out.filter((F.coalesce(F.col("question"), F.lit("")) != "") & (F.col("long_answer") != ""))
    if require_rows and out.isEmpty():
        raise ValueError(f"no question with an answer in split {split!r}" if split else "no question with an answer")
    if limit is not None:
        if not order_col:
            raise ValueError("limit needs an explicit order column")
        out = first_n(out, limit, order_col)
    return out.drop(*order)


def extract_guideline_text(df: DataFrame, fields: Sequence[str] = GUIDELINE_TEXT_FIELDS) -> Column:
    """The first non-empty preferred field (text, or a list of lines
    joined), else every textual value in column order joined by newlines;
    then whitespace is normalized."""
    sch = df.schema
    cands = []
    for f in fields:
        if f not in sch.fieldNames():
            continue
        dt = sch[f].dataType
        if isinstance(dt, T.ArrayType):
            lines = F.filter(F.transform(F.col(f), lambda e: py_strip(e.cast("string"))), lambda e: e != "")
            cands.append(F.when(F.size(lines) > 0, F.array_join(lines, "\n")))
        elif isinstance(dt, T.StringType):
            cands.append(F.when(F.coalesce(py_strip(F.col(f)), F.lit("")) != "", F.col(f)))
    fallback_parts = []
    for fld in sch.fields:
        if isinstance(fld.dataType, T.StringType):
            fallback_parts.append(F.array(blank_to_null(F.col(f"`{fld.name}`"))))
        elif isinstance(fld.dataType, T.ArrayType) and isinstance(fld.dataType.elementType, T.StringType):
            fallback_parts.append(F.transform(F.coalesce(F.col(f"`{fld.name}`"), F.array()), lambda e: blank_to_null(e)))
    fallback = F.array_join(F.filter(F.concat(*fallback_parts), lambda e: e.isNotNull()), "\n") if fallback_parts else F.lit("")
    return normalize_ws(F.coalesce(*cands, fallback))
