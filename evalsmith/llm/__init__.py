"""Operators for training-data pipelines (quality, privacy, dedup, mixing, archives).

Every module holds one operator; ``queries`` binds them to the driver tables.
Nothing outside this subpackage imports it.
"""
