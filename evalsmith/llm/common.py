"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from ..operators.ordering import running, shuffle_partitions
from ..session import shared_path, store, table

# Python workers receive this package's functions by value, so executors need
# no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

__all__ = ["as_text", "chunks", "running", "shared_path", "shuffle_partitions", "store", "table"]


def as_text(value) -> str:
    """A cell of a pandas string column as text; null is the empty text."""
    return value if isinstance(value, str) else ""


def chunks(lengths, limit: int):
    """Consecutive (start, stop) runs whose summed lengths stay near ``limit``;
    a single longer item is a run of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
