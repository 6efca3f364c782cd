"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces. Every window
of ``window`` consecutive words of a benchmark item (a shorter item whole) is
a pattern; one automaton over all patterns reads each normalised document
once. Matches become word ranges and, through the word positions, character
spans of the original text.

The benchmark is the side that is broadcast. What bounds an automaton is the
length of its windows, about ``window`` times the text, and a node of it takes
some 50 bytes: items whose windows come to more than ``block_bytes`` are cut
into blocks by a hash of the item. Each block is a pass of its own over the
documents, stored before the next: it broadcasts its items, keeps only the
documents that it hits, and its automaton goes before the next one comes. An
item is never cut; one alone beyond the bound is a block.

Defined results: null and empty texts have no words, are never hit and, as
items, hit nothing; a repeated item counts once; windows of an item without
item_id mark words but count no item; any text is scanned whole; columns of
the documents named like the result are replaced. An empty benchmark leaves
every document clean.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, store

#: Fixed: what parts words after A-Z is lower-cased, and the same over the original text.
_OTHER = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_TO_SPACE = bytes((c + 32) if 65 <= c <= 90 else 32 if c in _OTHER else c for c in range(256))
RESULT = "n_words long, n_hit long, items array<string>, ranges array<struct<first: long, last: long>>, spans array<struct<start: long, stop: long>>"


def words_of(text: str) -> list[bytes]:
    """The normalised words of a whole text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str | None, str]], window: int):
    """Automaton over all windows of the items; a window's value is its
    number of words and the ids of the items that have it. None if empty."""
    owners: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows_of(words_of(as_text(text)), window):
            owners.setdefault(w, set()).update([] if item_id is None else [item_id])
    if not owners:
        return None
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    a.make_automaton()
    return a


def scan(text: str, a) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, merged ranges of hit words (first, last), item ids."""
    words = words_of(text)
    if a is None or not words:
        return len(words), [], set()
    ends, lengths, items = [], [], set()
    for end, (n, ids) in a.iter(f" {b' '.join(words).decode('latin-1')} "):
        ends.append(end)
        lengths.append(n)
        items.update(ids)
    if not ends:
        return len(words), [], set()
    # The blank after word i is at this place of the joined text.
    blanks = np.cumsum([len(w) + 1 for w in words])
    last = np.searchsorted(blanks, np.array(ends))
    return len(words), merged(list(zip(last - np.array(lengths) + 1, last, strict=True))), items


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((int(a), int(b)) for a, b in ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, stop) in the original text of word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in ranges]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "leak", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with the struct ``out``: n_words, n_hit, items (sorted ids as
    strings), word ranges and character spans of the hits. Map-only over the
    documents; only their text crosses into Python."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long") * window)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))

    def shared(i: int):
        # One block at a time on the driver.
        own = items if blocks == 1 else items.where(part == i)
        return spark.sparkContext.broadcast({"items": [(r["id"], r["text"]) for r in own.toLocalIterator()]})

    if blocks == 1:
        return docs.withColumn(out, _scanner(shared(0), window)(F.col(text_col)))
    keyed = store(docs.withColumn("__leak_id", F.monotonically_increasing_id()), "leak-docs")
    hits = None
    for i in range(blocks):
        block = shared(i)
        found = keyed.select("__leak_id", _scanner(block, window)(F.col(text_col)).alias("l")).where("l.n_hit > 0")
        found = store(found.select("__leak_id", "l.ranges", "l.items"), "leak-hits")
        block.destroy()
        hits = found if hits is None else hits.unionAll(found)
    # At most a row per block and document.
    hits = hits.groupBy("__leak_id").agg(F.flatten(F.collect_list("ranges")).alias("__ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    joined = keyed.join(hits, "__leak_id", "left")
    return joined.withColumn(out, F.pandas_udf(_together, RESULT)(text_col, "__ranges", "__items")).drop("__leak_id", "__ranges", "__items")


def _scanner(shared, window: int):
    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        held = shared.value  # stays with the Python worker from task to task
        if "automaton" not in held:
            held["automaton"] = automaton(held["items"], window)
        rows = []
        for t in texts:
            text = as_text(t)
            n, ranges, items = scan(text, held["automaton"])
            rows.append(_row(text, n, ranges, items))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "ranges", "spans"])

    return run


def _row(text: str, n: int, ranges, items):
    return (
        n,
        sum(b - a + 1 for a, b in ranges),
        sorted(items),
        [{"first": a, "last": b} for a, b in ranges],
        [{"start": a, "stop": b} for a, b in spans_of(text, ranges)],
    )


def _together(texts: pd.Series, ranges: pd.Series, items: pd.Series) -> pd.DataFrame:
    """What the blocks have found of each text."""
    rows = []
    for t, own, ids in zip(texts, ranges, items, strict=True):
        text = as_text(t)
        own = [] if own is None else merged((r["first"], r["last"]) for r in own)
        rows.append(_row(text, len(words_of(text)), own, [] if ids is None else ids))
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "ranges", "spans"])
