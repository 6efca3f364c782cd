"""Text similarity expressions (F9, F10, F11 and the built-in test scorer).

The built-in scorer is directional token coverage: how much of the
hypothesis' token set the premise covers. It is asymmetric like entailment,
needs no model, and any SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, tokens


def coverage(premise_tokens, hypothesis_tokens) -> Column:
    """|P & H| / |H| over token sets; 0.0 when either side is empty."""
    p, h = col_of(premise_tokens), col_of(hypothesis_tokens)
    inter = F.size(F.array_intersect(p, h))
    return F.when((F.size(p) == 0) | (F.size(h) == 0), F.lit(0.0)).otherwise(inter / F.size(h))


def bidirectional(a_tokens, b_tokens) -> Column:
    """F10 score with the token scorer: min of both directions."""
    return F.least(coverage(a_tokens, b_tokens), coverage(b_tokens, a_tokens))


def lexical_overlap(a_tokens, b_tokens) -> Column:
    """shared tokens / smaller set; 0.0 if either is empty."""
    a, b = col_of(a_tokens), col_of(b_tokens)
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / F.least(F.size(a), F.size(b)))


def lexical_overlap_text(a, b) -> Column:
    return lexical_overlap(tokens(a), tokens(b))


def similarity_label(score, threshold: float) -> Column:
    """F10 label: same if score >= t, else different; unknown for a null score."""
    s = col_of(score)
    return F.when(s.isNull(), "unknown").when(s >= threshold, "same").otherwise("different")


def cosine(a, b) -> Column:
    """cosine of two embedding arrays; 0.0 when either is empty or zero."""
    x, y = col_of(a), col_of(b)
    dot = F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, t: acc + t)
    nx = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, u: acc + u.cast("double") * u.cast("double")))
    ny = F.sqrt(F.aggregate(y, F.lit(0.0), lambda acc, u: acc + u.cast("double") * u.cast("double")))
    return F.when(
        x.isNull() | y.isNull() | (F.size(x) == 0) | (F.size(y) == 0) | (nx == 0) | (ny == 0), F.lit(0.0)
    ).otherwise(dot / (nx * ny))
