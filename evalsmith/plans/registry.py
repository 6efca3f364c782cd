"""All query bindings and their DuckDB oracles, by name."""

from __future__ import annotations

import importlib

# Plan modules, each exposing QUERIES (name -> callable) and oracles().
_MODULES = [
    "judging",
    "guidelines",
    "actions",
    "sessions",
    "decisions",
    "terms",
    "generation",
    "records",
    "vectors",
]


def _mods():
    return [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def oracles() -> dict:
    out: dict = {}
    for m in _mods():
        out.update(m.oracles())
    return out
