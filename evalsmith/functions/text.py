"""Text helpers as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes Unicode whitespace and the separators
# \x1c-\x1f; Spark's trim() removes only the space character.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{_WS}+|{_WS}+$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip like Python ``str.strip()``."""
    return F.regexp_replace(col_of(c), _STRIP_RE, "")


def blank_to_null(c) -> Column:
    """Null for null, empty or whitespace-only text, else the stripped text."""
    s = py_strip(c)
    return F.when(s != "", s)


def first_nonblank(*cols) -> Column:
    """First argument that is not null and not blank (stripped)."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_ws(c) -> Column:
    """CRLF to LF, runs of space / tab to one space, 3+ newlines to 2, strip."""
    x = F.replace(col_of(c), F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return py_strip(x)


def norm_text(c) -> Column:
    """Lower-case, every run outside [a-z0-9] becomes one space, stripped."""
    x = F.regexp_replace(F.lower(col_of(c)), r"[^a-z0-9]+", " ")
    return F.trim(x)


def tokens(c) -> Column:
    """Distinct normalized tokens of a text; empty array for blank or null."""
    n = norm_text(F.coalesce(col_of(c), F.lit("")))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " ")))


def bullet_list(arr, drop_blank: bool = True) -> Column:
    """``- item`` per line; blank items dropped (GC style) or kept (ACT style)."""
    items = F.transform(col_of(arr), lambda a: py_strip(a))
    if drop_blank:
        items = F.filter(items, lambda a: a != "")
    return F.array_join(F.transform(items, lambda a: F.concat(F.lit("- "), a)), "\n")
