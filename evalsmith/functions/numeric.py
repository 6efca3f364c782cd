"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

# Beyond 2**53 every double is already an integer; also keeps floor() from
# saturating its BIGINT result.
_EXACT_LIMIT = 9.007199254740992e15


def truncate_float(c, digits: int = 3) -> Column:
    """P10 on one column: truncate toward zero to ``digits`` decimals.

    NaN, infinities and huge values pass through unchanged (``floor`` of NaN
    is 0 and of 1e300 saturates in Spark).
    """
    if digits < 0:
        raise ValueError("digits must be >= 0")
    x = col_of(c).cast("double")
    f = float(10**digits)
    scaled = F.abs(x) * f
    return F.when(x.isNull() | F.isnan(x) | (scaled >= _EXACT_LIMIT), x).otherwise(
        F.signum(x) * F.floor(scaled) / f
    )


def safe_div(num, den) -> Column:
    """num / den as double, 0.0 when den is 0 (or null)."""
    n, d = col_of(num).cast("double"), col_of(den).cast("double")
    return F.when(F.coalesce(d, F.lit(0.0)) != 0, n / d).otherwise(F.lit(0.0))
