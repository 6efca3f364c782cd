"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit set where over half of its shingle hashes have
it. Fingerprints within ``max_bits`` differing bits are linked; a document's
component is everything reachable over links.

The join: with ``max_bits + 1`` bit blocks, two linked fingerprints agree on
one block at least. Each distinct fingerprint goes once per block to the task
of its (block, value), rotated so that the block leads. There the sorted
fingerprints are a binary trie whose nodes are index ranges. Node pairs are
walked down together, adding one differing bit where they take different
branches, and dropped beyond the budget. Tasks return a spanning forest of
their links (never all pairs), and components are then grown over the forest
edges with Spark joins.

Copies collapse to one fingerprint before anything is compared. A block value
held by more fingerprints than ``task_rows`` is dealt over several tasks: its
members hash into chunks and every pair of chunks meets in one task.

Defined results: a null or empty text has fingerprint zero and links like any
other; fewer words than the shingle length make one shingle; repeated rows
have equal results; texts of any length are hashed whole, a part at a time;
columns of the documents named like the results take no part; a component's id is its smallest doc_id (null only if all
are null); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import as_text, shuffle_partitions, store

SEED = 42
#: Shingles hashed at a time within one text, pairs of trie nodes at a time.
_HASHES, _PAIRS = 1 << 16, 1 << 20


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one whole text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [tuple(words)]
    else:
        grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    counts, total, part = np.zeros(64, np.int64), 0, []

    def flush():
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)

    digest = xxhash.xxh64_intdigest
    for g in grams:
        part.append(digest(b" ".join(g), SEED))
        if len(part) == _HASHES:
            counts, total, part = counts + flush(), total + len(part), []
    if part:
        counts, total = counts + flush(), total + len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a bigint column; map-only."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(as_text(t), shingle) for t in texts], dtype="int64")

    return docs.withColumn(out, run(F.col(text_col)))


class Forest:
    """Union of index pairs, kept as the smallest index of each component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while True:
            la, lb = lab[a], lab[b]
            new = la != lb
            if not new.any():
                break
            a, b, la, lb = a[new], b[new], la[new], lb[new]
            np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
            while (up := lab[lab]).tobytes() != lab.tobytes():
                lab[:] = up


def trie_links(keys: np.ndarray, group: np.ndarray, member: np.ndarray, forest: Forest, lead: int, max_bits: int) -> None:
    """Joins in ``forest`` the members of each group whose keys are near.

    keys: uint64, the keys of one group sharing their first ``lead`` bits;
    (group, key) ascending and without repeats. member: the forest's index.
    """
    n = len(keys)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ((keys[1:] ^ keys[:-1]) >> np.uint64(64 - lead) != 0)])
    stops = np.r_[starts[1:], n]
    many = stops - starts > 1
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit.astype(np.int32))].astype(np.int32)
        return ones[depth]

    # A chunk holds node pairs of one depth: ranges [a, b) and [c, d) of the
    # sorted keys and the bits they differ in so far; a == c is a node itself.
    s, e = starts[many], stops[many]
    todo = [(lead, s[i : i + _PAIRS], e[i : i + _PAIRS], s[i : i + _PAIRS], e[i : i + _PAIRS], np.zeros(len(s[i : i + _PAIRS]), np.int8)) for i in range(0, len(s), _PAIRS)]
    while todo:
        depth, a, b, c, d, diff = todo.pop()
        single = (b - a == 1) & (d - c == 1)
        if single.any():
            i, j = a[single], c[single]
            near = (forest.label[member[i]] != forest.label[member[j]]) & (np.bitwise_count(keys[i] ^ keys[j]) <= max_bits)
            if near.any():
                forest.join(member[i[near]], member[j[near]])
            a, b, c, d, diff = (x[~single] for x in (a, b, c, d, diff))
        if not len(a) or depth == 64:
            continue
        # Subtrees that are one component already have nothing to add.
        lab = forest.label[member]
        breaks = np.r_[0, np.cumsum(lab[1:] != lab[:-1])]
        open_ = (breaks[b - 1] != breaks[a]) | (breaks[d - 1] != breaks[c]) | (lab[a] != lab[c])
        a, b, c, d, diff = (x[open_] for x in (a, b, c, d, diff))
        cum = ones_before(depth)
        m, k = b - (cum[b] - cum[a]), d - (cum[d] - cum[c])
        other = a != c
        na = np.r_[a, m, a, m[other]]
        nb = np.r_[m, b, m, b[other]]
        nc = np.r_[c, k, k, c[other]]
        nd = np.r_[k, d, d, k[other]]
        nf = np.r_[diff, diff, diff + 1, diff[other] + 1]
        ok = (na < nb) & (nc < nd) & (nf <= max_bits) & ~((na == nc) & (nb - na < 2))
        na, nb, nc, nd, nf = (x[ok] for x in (na, nb, nc, nd, nf))
        for i in range(0, len(na), _PAIRS):
            todo.append((depth + 1, *(x[i : i + _PAIRS] for x in (na, nb, nc, nd, nf))))


def _links(max_bits: int):
    width = 64 // (max_bits + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        all_ = pd.concat(held, ignore_index=True)
        fps = all_["fp"].to_numpy(np.int64)
        nodes, member = np.unique(fps, return_inverse=True)
        forest = Forest(len(nodes))
        shift = (all_["block"].to_numpy(np.uint64) * np.uint64(width)) % np.uint64(64)
        raw = fps.view(np.uint64)
        keys = np.where(shift == 0, raw, (raw << shift) | (raw >> ((np.uint64(64) - shift) % np.uint64(64))))
        # Groups by (block, chunk pair); the leading block is in the key.
        tag = (all_["block"].to_numpy(np.int64) << 40) | (all_["x"].to_numpy(np.int64) << 20) | all_["y"].to_numpy(np.int64)
        order = np.lexsort((keys, tag))
        trie_links(keys[order], tag[order], member[order], forest, width, max_bits)
        child = np.flatnonzero(forest.label != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[child], "v": nodes[forest.label[child]]})

    return run


def near_links(fps: DataFrame, max_bits: int = 3, task_rows: int = 100_000, least_group: int = 1024) -> DataFrame:
    """Forest edges (u, v), v < u, that connect distinct fingerprints ``fp``
    exactly as all links within ``max_bits`` bits would.

    ``fps`` is read more than once: pass a stored table of distinct values.
    """
    spark = fps.sparkSession
    blocks = max_bits + 1
    width = 64 // blocks
    n = fps.count()
    parts = shuffle_partitions(spark, n * blocks, task_rows)
    # A value may fill about a fair task; beyond, it is dealt over chunks (of
    # no less than ``least_group``, as chunks meet in pairs).
    group_rows = max(least_group, min(task_rows, n * blocks // parts))
    value = lambda b: F.shiftrightunsigned(F.shiftleft("fp", b * width), 64 - width)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), value(b).alias("value")) for b in range(blocks)])).alias("k")).select("fp", "k.*")
    hot = store(keyed.groupBy("block", "value").count().where(F.col("count") > group_rows), "simhash-hot")
    if hot.isEmpty():
        dealt = keyed.withColumns({"x": F.lit(0), "y": F.lit(0)})
    else:
        chunks = F.ceil(F.col("count") / group_rows).cast("int")
        own = F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), chunks)).cast("int")
        dealt = (
            keyed.join(hot, ["block", "value"], "left")
            .select("fp", "block", "value", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1)).alias("with"))
            .select("fp", "block", "value", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
        )
    return dealt.repartition(parts, "block", "value", "x", "y").select("fp", "block", "x", "y").mapInPandas(_links(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, task_rows: int = 100_000) -> DataFrame:
    """One row per document: ``doc_id``, ``text_hash``, ``fp`` and
    ``component_id``, the smallest doc_id reachable; ``first_hash`` is the
    smallest text hash among the component's rows of that id.

    Documents cross the network without their texts.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = store(fingerprints(slim, shingle).drop("text"), "simhash-docs")
    # Nulls last: a null id stands first only where there is no other.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = store(rows.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    linked = components(near_links(classes.select("fp"), max_bits, task_rows), "simhash-edges")
    # A root has no row of its own: it leads to itself.
    member = store(classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-members")
    roots = store(member.groupBy("root").agg(F.min("first").alias("first")), "simhash-roots")
    named = store(member.select("fp", "root").join(roots, "root").select("fp", "first"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3, task_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that stand first in their component, one of equal
    (doc_id, text). Texts are shuffled once, by their key; copies are counted
    out on the slim rows before that."""
    found = near_duplicates(docs, shingle, max_bits, task_rows)
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    # One key, never null, for the join and for counting out copies: the texts
    # are partitioned by it once.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    firsts = firsts.select(name.alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumns({"__id": name, "__hash": F.xxhash64("text")})
    kept = keyed.join(store(firsts, "simhash-firsts"), ["__id", "__hash"], "left_semi")
    return kept.dropDuplicates(["__id", "__hash"]).select(*docs.columns)
