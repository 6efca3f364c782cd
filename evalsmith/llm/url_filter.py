"""URL filters: a trie over reversed host labels, then path segments.

Rules are (action, host, path) entries. A rule fits its host and all
subdomains, where the URL's path begins with the rule's path. The trie has
the host labels from the right, then the path's whole segments; what follows
the last slash of a rule's path is kept at its node as a segment beginning.
The longest fitting rule wins: more host labels first, then the longer path;
between an allow and a block entry of the same place block wins. URLs that no
rule fits get the default.

A trie of up to ``broadcast_rules`` rules is broadcast and walked once per
URL. More rules are cut into blocks of that many by a hash of their host and
path; each URL passes every block's trie in the same map-only job and keeps
the longest rule.

Defined results: a null URL or one without ``://`` has empty host and path
and gets the default; a rule with an empty host fits nothing; repeated rules
and rows are harmless; very long URLs are read whole; columns named like the
result are replaced; without rules all URLs get the default; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Fixed: host up to a slash, question mark or hash; path up to the latter two.
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RESULT = "host string, path string, rule string, action string, labels int, path_length int"


def parts_of(url: str) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    m = _URL.search(url)
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class _Paths:
    """A node of a path trie: children by whole segment; rules by the
    beginning of the next segment, and the lengths of those beginnings."""

    def __init__(self):
        self.segments: dict[str, _Paths] = {}
        self.begins: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []


class _Hosts:
    """A node of the host trie: children by label, and the path trie of the
    rules for the host that ends here."""

    def __init__(self):
        self.labels: dict[str, _Hosts] = {}
        self.paths: _Paths | None = None


class Trie:
    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root = _Hosts()
        for action, host, path in rules:
            if not host:
                continue
            host = host.translate(_LOWER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.labels.setdefault(label, _Hosts())
            node.paths = node.paths or _Paths()
            at = node.paths
            *whole, begin = path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Paths())
            if begin not in at.begins or action == "block":
                at.begins[begin] = (action, host + path)
                at.lengths = sorted({len(x) for x in at.begins})

    def longest(self, host: str, path: str):
        """(action, rule, labels, path length) of the longest fitting rule."""
        best, node, segments = None, self.root, path.split("/")
        for n, label in enumerate(reversed(host.split(".")), 1):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None and (found := _longest_path(node.paths, segments)):
                best = (found[0], found[1], n, found[2])
        return best


def _longest_path(node: _Paths | None, segments: list[str]):
    best, passed = None, 0
    for segment in segments:
        for k in node.lengths:
            if k <= len(segment) and (hit := node.begins.get(segment[:k])):
                best = (*hit, passed + k)
        node = node.segments.get(segment)
        if node is None:
            break
        passed += len(segment) + 1
    return best


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", out: str = "judged", default: str = "allow", broadcast_rules: int = 200_000) -> DataFrame:
    """``df`` with the struct ``out``: host, path, rule (as ``host/path``, null
    if none fits), action, labels and path_length of the rule; map-only, and
    only the URL crosses into Python."""
    blocks: list[list] = [[] for _ in range(max(1, -(-len(rules) // broadcast_rules)))]
    for r in rules:
        blocks[zlib.crc32(f"{r[1].translate(_LOWER)}{r[2]}".encode()) % len(blocks)].append(r)
    found = df
    names = [f"__{out}_{i}" for i in range(len(blocks))]
    for name, block in zip(names, blocks, strict=True):
        found = found.withColumn(name, _walk(df, block)(url_col))
    best = F.greatest(*[_order(F.col(n)) for n in names]) if len(names) > 1 else _order(F.col(names[0]))
    action = F.coalesce(best["action"], F.lit(default))
    judged = F.struct(F.col(names[0])["host"].alias("host"), F.col(names[0])["path"].alias("path"), best["rule"].alias("rule"), action.alias("action"), best["labels"].alias("labels"), best["path_length"].alias("path_length"))
    return found.withColumn(out, judged).drop(*names)


def _order(c: Column) -> Column:
    """The result with what decides between blocks first; block before allow."""
    return F.struct(c["labels"].alias("labels"), c["path_length"].alias("path_length"), c["action"].alias("action"), c["rule"].alias("rule"))


def _walk(df: DataFrame, rules: Sequence[tuple[str, str, str]]):
    shared = df.sparkSession.sparkContext.broadcast({"rules": list(rules)})

    def run(urls: pd.Series) -> pd.DataFrame:
        held = shared.value  # stays with the Python worker from task to task
        if "trie" not in held:
            held["trie"] = Trie(held["rules"])
        rows = []
        for u in urls:
            host, path = parts_of(as_text(u))
            action, rule, labels, length = held["trie"].longest(host, path) or (None, None, -1, -1)
            rows.append((host, path, rule, action, labels, length))
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in RESULT.split(", ")]).astype({"labels": "int32", "path_length": "int32"})

    return F.pandas_udf(run, RESULT)
