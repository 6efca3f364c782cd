"""Quality rules as a bitmask ledger.

Each rule is evaluated once per text. The ledger row keeps the measurements
and one bigint whose bit *i* is set where rule *i* fails. A policy is only a
mask over these bits, so applying a new policy version or asking what a rule
costs never reads the texts again.

Defined results: a null or empty text has no words, fails ``too_few_words``
alone and is never an error; repeated rows get equal ledger rows; a text is
measured whole, whatever its length; an empty table gives an empty ledger.
Columns of the input that the ledger also makes are replaced by the ledger's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text

MEASURES = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper n_letters".split()
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_CONTINUED = bytes(range(0x80, 0xC0))


def measure_text(text: str) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``.

    Words are the runs between space and 0x09-0x0D. A line counts where it
    has a word; it is a duplicate where an earlier line of the text is equal.
    A repeated word stands in a three-word window found twice or more.
    """
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        covered = 0  # words before this position are counted already
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3

    def count(b: bytes) -> int:
        return len(raw) - len(raw.translate(None, b))

    return (
        len(words),
        len(raw) - count(_SPACE + _CONTINUED),
        count(_SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        count(_UPPER),
        count(_LETTERS),
    )


def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(as_text(t)) for t in texts], columns=MEASURES, dtype="int64")


@dataclass(frozen=True)
class Rule:
    """``fails`` makes a condition of the measurements; a bit is never given anew."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


RULES = (
    Rule(0, "too_few_words", lambda m: m.n_words < 50),
    Rule(1, "repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule(2, "symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule(3, "duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    Rule(4, "upper_case", lambda m: 2 * m.n_upper > m.n_letters),
    Rule(5, "word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 25 * m.n_words)),
)
BASE = ("too_few_words", "repeated_words")
#: Versioned policies: the rules each version enforces.
POLICIES = {"v1": BASE, "v2": tuple(r.name for r in RULES)}


def mask_of(names, rules=RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def ledger(docs: DataFrame, rules=RULES, text_col: str = "text", measures_col: str = "measures", bits_col: str = "fail_bits") -> DataFrame:
    """``docs`` with a struct of measurements and the failure bits; map-only.

    Only the text crosses into Python, once per row.
    """
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(F.col(measures_col)), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return docs.withColumn(measures_col, F.pandas_udf(_measure, ", ".join(f"{m} long" for m in MEASURES))(text_col)).withColumn(bits_col, bits)


def passes(policy: str, policies=POLICIES, rules=RULES, bits_col: str = "fail_bits") -> Column:
    """Whether a ledger row passes the policy version."""
    return F.col(bits_col).bitwiseAND(F.lit(mask_of(policies[policy], rules)).cast("long")) == 0


def ablations(ledgered: DataFrame, policies=POLICIES, rules=RULES, bits_col: str = "fail_bits", words: str = "measures.n_words") -> DataFrame:
    """Per policy and rule, from the bits alone: documents that fail the rule,
    that fail it alone within the policy (what dropping the rule would let
    in), and their words. The rows shrink to one per distinct mask before any
    rule is looked at, so the shuffle carries at most 2^rules rows a task.
    """
    masks = ledgered.groupBy(F.col(bits_col).alias("bits")).agg(F.count("*").alias("docs"), F.sum(words).alias("words"))
    spec = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(mask_of(names, rules)).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for p, names in policies.items() for r in rules if r.name in names
    ])
    s = masks.select("*", F.explode(spec).alias("s")).select("bits", "docs", "words", "s.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits").bitwiseAND(F.col("mask")) == F.col("bit")
    return s.groupBy("policy", "rule").agg(
        F.sum("docs").alias("n_docs"),
        F.coalesce(F.sum(F.when(fails, F.col("docs"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(alone, F.col("docs"))), F.lit(0)).alias("n_fail_alone"),
        F.coalesce(F.sum(F.when(alone, F.col("words"))), F.lit(0)).alias("words_alone"),
        F.expr("bit_or(bits & mask)").alias("bits_seen"),
        F.expr("sum(if(bits & mask = 0, docs, 0))").alias("n_kept"),
    )
