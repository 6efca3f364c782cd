"""Action-list matching: candidates, pair scores, greedy matching, semantic
de-duplication and match metrics (J5-J8, F9, F10, T2, T3, W6, A15).

Scale design
------------
* Lists are exploded to one row per action ``(case keys, idx, text)``.
* Candidate pairs inside a case come from an inverted token index with
  prefix filtering (an exact set-similarity join for the token scorer): a
  pair whose token overlap reaches ``tau * min(|a|, |b|)`` always shares a
  token in the smaller item's prefix. Tokens are ordered by length and hash,
  an order every task knows, so prefixes need no shuffle and no count over
  all cases. No case emits all of its pairs, and a case holding a third of
  all rows is spread over its (case, token) join keys.
* For any other scorer the caller brings the candidate pairs (its blocking),
  and each distinct text pair is scored once (``score_distinct_pairs``).
* Greedy matching (T2) and keep-first de-duplication (T3) are sequential by
  definition. ``ROUNDS`` rounds settle what depends on nothing undecided; what
  is left is a system of decisions that ``settle`` decides by pointer doubling:
  a chain of a million in one case takes about twenty rounds of joins. Dense
  ties, where each decision waits for several others, can be deeper than that
  (both problems are P-complete); what its rounds leave is dealt by connected
  component and decided in order while it streams, sorted, through a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from ..functions.replies import norm_action
from ..functions.similarity import bidirectional, coverage, lexical_overlap, similarity_label
from ..functions.text import py_strip, tokens
from ..session import store
from .graph import components
from .ordering import numbered_within
from .settle import same_rows, settle

#: Rounds that take what depends on nothing, before the rest is settled.
ROUNDS = 2


def explode_actions(df: DataFrame, keys: Sequence[str], col: str, idx: str = "idx", text: str = "text") -> DataFrame:
    """One row per list element, position kept."""
    return df.select(*keys, F.posexplode(F.coalesce(F.col(col), F.array())).alias(idx, text))


def keep_first_distinct_rows(df: DataFrame, keys: Sequence[str], idx: str = "idx", text: str = "text") -> DataFrame:
    """W6 (row form): drop blank and repeated actions (after normalization),
    keeping the first spelling, stripped. One algebraic aggregation per
    (case, normalized text): partial aggregation absorbs repeats map-side."""
    n = norm_action(F.col(text))
    g = (
        df.withColumn("_norm", n)
        .filter(F.col("_norm") != "")
        .groupBy(*keys, "_norm")
        .agg(F.min(F.struct(F.col(idx).alias("i"), py_strip(F.col(text)).alias("t"))).alias("_first"))
    )
    return g.select(*keys, F.col("_first.i").alias(idx), F.col("_first.t").alias(text))


def tokenize(items: DataFrame, text: str = "text", out: str = "tok") -> DataFrame:
    """Add the distinct normalized token set of each item (computed once per
    item, so pair predicates never re-run the regex per pair)."""
    return items if out in items.columns else items.withColumn(out, tokens(text))


def _tokenized(df: DataFrame, keys, id_col: str, text: str, tau: float) -> DataFrame:
    """Items with their tokens in the common order (longer ones, which are
    rarer, first) and the length of the prefix that ``tau`` requires."""
    tok = F.col("tok") if "tok" in df.columns else tokens(text)
    placed = F.array_sort(F.transform(tok, lambda t: F.struct((-F.length(t)).alias("l"), F.xxhash64(t).alias("h"), t.alias("t"))))
    n = F.size("_tok")
    need = F.greatest(F.ceil(n * F.lit(tau) - F.lit(1e-9)), F.lit(1))
    t = df.select(*keys, F.col(id_col).alias("_id"), F.transform(placed, lambda x: x["t"]).alias("_tok"))
    return t.where(n > 0).select("*", n.alias("_n"), (n - need + 1).cast("int").alias("_k"))


def _probe_and_index(t: DataFrame, keys):
    """Prefix token rows and all token rows of each item."""
    cols = [*keys, "_id", "_n"]
    return t.select(*cols, F.explode(F.slice("_tok", F.lit(1), F.col("_k"))).alias("_token")), t.select(*cols, F.explode("_tok").alias("_token"))


def _never_broadcast(df: DataFrame) -> DataFrame:
    """Token rows and token sets are many times what the input's file size lets
    Spark expect: a join that took it for small would build them in the driver."""
    return df.hint("merge")


def overlap_candidates(
    left: DataFrame,
    right: DataFrame | None,
    keys: Sequence[str],
    tau: float,
    id_col: str = "idx",
    text: str = "text",
    mode: str = "min",
) -> DataFrame:
    """Exact candidate pairs ``(keys, a, b)`` inside each case.

    ``mode="min"``: every pair whose distinct-token overlap is at least
    ``tau`` times the SMALLER token set (overlap coefficient, F9, T3); the
    smaller item's prefix probes the other's full token index.
    ``mode="max"``: every pair whose overlap is at least ``tau`` times the
    LARGER set (the two-way token score, F10 / T2); then both prefixes must
    share a token and the sizes are within a factor ``tau``, so prefixes join
    prefixes. Either way some extra pairs may come back; none is missed. Pairs
    without a common token are never candidates: a threshold of 0 would ask
    for all pairs of a case, and ``tau`` must be above it.
    ``right=None`` gives unordered self pairs with ``a < b``.
    """
    if not 0 < tau <= 1:
        raise ValueError("tau must be in (0, 1]")
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    keys = list(keys)
    lp, li = _probe_and_index(_tokenized(left, keys, id_col, text, tau), keys)
    rp, ri = (lp, li) if right is None else _probe_and_index(_tokenized(right, keys, id_col, text, tau), keys)
    if mode == "max":
        a = lp.select(*keys, "_token", F.col("_id").alias("a"), F.col("_n").alias("_an"))
        b = rp.select(*keys, "_token", F.col("_id").alias("b"), F.col("_n").alias("_bn"))
        eps = F.lit(1e-9)
        c = a.join(_never_broadcast(b), [*keys, "_token"]).filter(
            (F.col("_an") >= F.col("_bn") * tau - eps) & (F.col("_bn") >= F.col("_an") * tau - eps)
        )
        if right is None:
            c = c.filter(F.col("a") < F.col("b"))
        return c.select(*keys, "a", "b").distinct()
    if right is None:
        p = lp.select(*keys, "_token", F.col("_id").alias("_p"), F.col("_n").alias("_pn"))
        i = li.select(*keys, "_token", F.col("_id").alias("_i"), F.col("_n").alias("_in"))
        c = p.join(_never_broadcast(i), [*keys, "_token"]).filter(
            (F.col("_pn") < F.col("_in")) | ((F.col("_pn") == F.col("_in")) & (F.col("_p") < F.col("_i")))
        )
        return c.select(*keys, F.least("_p", "_i").alias("a"), F.greatest("_p", "_i").alias("b")).distinct()
    c1 = lp.select(*keys, "_token", F.col("_id").alias("a"), F.col("_n").alias("_an")).join(
        _never_broadcast(ri.select(*keys, "_token", F.col("_id").alias("b"), F.col("_n").alias("_bn"))), [*keys, "_token"]
    ).filter(F.col("_an") <= F.col("_bn"))
    c2 = rp.select(*keys, "_token", F.col("_id").alias("b"), F.col("_n").alias("_bn")).join(
        _never_broadcast(li.select(*keys, "_token", F.col("_id").alias("a"), F.col("_n").alias("_an"))), [*keys, "_token"]
    ).filter(F.col("_bn") < F.col("_an"))
    return c1.select(*keys, "a", "b").unionByName(c2.select(*keys, "a", "b")).distinct()


def attach_texts(
    pairs: DataFrame, left: DataFrame, right: DataFrame, keys, id_col: str = "idx", text: str = "text", with_text: bool = True
) -> DataFrame:
    """Bring the token sets (and texts, unless ``with_text=False``) of both
    ends back to candidate pairs (two key joins)."""
    keys = list(keys)
    has_tok_l, has_tok_r = "tok" in left.columns, "tok" in right.columns
    lcols = [F.col(id_col).alias("a")] + ([F.col(text).alias("text_a")] if with_text or not has_tok_l else []) + (
        [F.col("tok").alias("tok_a")] if has_tok_l else []
    )
    rcols = [F.col(id_col).alias("b")] + ([F.col(text).alias("text_b")] if with_text or not has_tok_r else []) + (
        [F.col("tok").alias("tok_b")] if has_tok_r else []
    )
    l = left.select(*keys, *lcols)
    r = right.select(*keys, *rcols)
    return pairs.join(_never_broadcast(l), [*keys, "a"]).join(_never_broadcast(r), [*keys, "b"])


def token_pair_scores(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Built-in scorer on each pair: forward = coverage of b by a,
    backward = coverage of a by b, score = min (F10), overlap (F9).

    Uses ``tok_a`` / ``tok_b`` when the pairs carry them (tokenize items
    before pairing); otherwise tokenizes here."""
    p = pairs
    if "tok_a" not in p.columns:
        p = p.withColumn("tok_a", tokens(a))
    if "tok_b" not in p.columns:
        p = p.withColumn("tok_b", tokens(b))
    return (
        p.withColumn("forward", coverage("tok_a", "tok_b"))
        .withColumn("backward", coverage("tok_b", "tok_a"))
        .withColumn("score", bidirectional("tok_a", "tok_b"))
        .withColumn("overlap", lexical_overlap("tok_a", "tok_b"))
        .drop("tok_a", "tok_b")
    )


def score_distinct_pairs(pairs: DataFrame, scorer, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Score each distinct (text_a, text_b) once with ``scorer`` (a
    DataFrame -> DataFrame adding ``forward`` / ``backward``, e.g. a model
    call through ``inference.score_batches``) and join the scores back."""
    distinct = pairs.select(a, b).distinct()
    scored = scorer(distinct).select(a, b, "forward", "backward")
    return pairs.join(scored, [a, b], "left").withColumn("score", F.least("forward", "backward"))


def label_pairs(pairs: DataFrame, threshold: float, a: str = "text_a", b: str = "text_b", scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """F10 row by row: ``forward``, ``backward``, ``score`` and ``label`` of
    every given pair. A blank or null side scores 0; a score the scorer did
    not give leaves the label ``unknown``. ``scorer`` sees each distinct pair
    once (J7); without one the token scorer's columns are computed in place."""
    blank = (F.trim(F.coalesce(F.col(a), F.lit(""))) == "") | (F.trim(F.coalesce(F.col(b), F.lit(""))) == "")
    if scorer is None:
        scored = token_pair_scores(pairs, a, b).drop("overlap")
    else:
        known = score_distinct_pairs(pairs.where(~blank).select(a, b).distinct(), scorer, a, b).drop("score")
        scored = pairs.join(known, [a, b], "left")
    zero = lambda c: F.when(blank, 0.0).otherwise(F.col(c))
    scored = scored.withColumns({"forward": zero("forward"), "backward": zero("backward")})
    # least() would skip a null side.
    score = F.when(F.col("forward").isNotNull() & F.col("backward").isNotNull(), F.least("forward", "backward"))
    return scored.withColumn("score", score).withColumn("label", similarity_label("score", threshold))


# -- J5: all pairs of a case ------------------------------------------------------


def action_classes(items: DataFrame, keys: Sequence[str], idx: str = "idx", text: str = "text") -> DataFrame:
    """(keys, idx, tok, n, members): the actions of a case with equal token
    sets as one row, named by the first of them; ``members`` are all."""
    own = tokenize(items, text).select(*keys, idx, F.array_sort("tok").alias("tok"))
    return own.groupBy(*keys, "tok").agg(F.min(idx).alias(idx), F.count("*").alias("n"), F.array_sort(F.collect_list(idx)).alias("members"))


def case_pairs(generated: DataFrame, reference: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """J5 + F10 over every generated x reference pair of a case, factored:
    (keys, g, r, n_pairs, forward, backward, score, label).

    A row stands for all pairs of two classes (``action_classes``) that share a
    token, g and r being the first of each. Pairs without a common token score
    0 whatever they are; they aren't listed but counted, in one row a case with
    null g and r. ``n_pairs`` of a case sum up to |generated| x |reference|."""
    keys = list(keys)
    left, right = (store(action_classes(x, keys).drop("members"), "pair-classes") for x in (generated, reference))
    # A prefix of all tokens: whatever shares one is a candidate.
    linked = overlap_candidates(left, right, keys, 1e-6)
    pairs = linked.join(left.select(*keys, F.col("idx").alias("a"), F.col("tok").alias("tok_a"), F.col("n").alias("n_a")), [*keys, "a"])
    pairs = pairs.join(right.select(*keys, F.col("idx").alias("b"), F.col("tok").alias("tok_b"), F.col("n").alias("n_b")), [*keys, "b"])
    listed = token_pair_scores(pairs).select(*keys, F.col("a").alias("g"), F.col("b").alias("r"), (F.col("n_a") * F.col("n_b")).alias("n_pairs"), "forward", "backward", "score")
    listed = store(listed, "pair-listed")
    total = lambda side, name: side.groupBy(*keys).agg(F.sum("n").alias(name))
    left_over = total(left, "_g").join(total(right, "_r"), keys).join(listed.groupBy(*keys).agg(F.sum("n_pairs").alias("_n")), keys, "left")
    left_over = left_over.select(*keys, (F.col("_g") * F.col("_r") - F.coalesce("_n", F.lit(0))).alias("n_pairs")).where("n_pairs > 0")
    zero = [F.lit(0.0).alias(c) for c in ("forward", "backward", "score")]
    nothing = left_over.select(*keys, F.lit(None).cast("int").alias("g"), F.lit(None).cast("int").alias("r"), "n_pairs", *zero)
    return listed.unionByName(nothing).withColumn("label", similarity_label("score", threshold))


# -- T2: greedy matching --------------------------------------------------------


def _component_of(edges: DataFrame, u: Column, v: Column, name: str) -> DataFrame:
    """``edges`` with the ``_root`` of their connected component. Nodes are
    64-bit hashes; two that collide only share a task."""
    e = store(edges.withColumns({"_u": u, "_v": v}), name)
    found = components(e.select(F.col("_u").alias("u"), F.col("_v").alias("v")), name)
    joined = e.join(found, F.col("_u") == F.col("node"), "left").select("*", F.coalesce("root", "_u").alias("_root"))
    return joined.drop("_u", "_v", "node", "root")


def _take_in_order(keys: list[str]) -> Callable:
    """Takes rows whose two endpoints are both free, in the order given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, used = None, set()
        for f in frames:
            take = []
            for at, g, r, *case in zip(f["_root"], f["g"], f["r"], *[f[k] for k in keys], strict=True):
                if at != root:
                    root, used = at, set()
                ends = ("g", g, *case), ("r", r, *case)
                free = used.isdisjoint(ends)
                if free:
                    used.update(ends)
                take.append(free)
            yield f.loc[take, [*keys, "g", "r", "score"]]

    return run


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


#: Cases and endpoints with more rows than this are numbered in ranges.
WINDOW_ROWS = 1_000_000


def _with_previous(edges: DataFrame, keys: list[str], end: str, other: str) -> DataFrame:
    """``edges`` with the edge before each at its endpoint ``end`` (its
    ``other`` end, null for the first) and whether another follows."""
    order = [F.col("score").desc(), F.col(other)]
    most = edges.groupBy(*keys, end).count().agg(F.max("count")).first()[0]
    if most <= WINDOW_ROWS:
        w = Window.partitionBy(*keys, end).orderBy(*order)
        return edges.withColumns({f"before_{end}": F.lag(other).over(w), f"more_{end}": F.lead(other).over(w).isNotNull()})
    placed = store(numbered_within(edges, [*keys, end], order, "_at"), "greedy-placed")
    near = lambda step, out: placed.select(*keys, end, F.col(other).alias(out), (F.col("_at") + step).alias("_at"))
    placed = placed.join(near(1, f"before_{end}"), [*keys, end, "_at"], "left").join(near(-1, "_next"), [*keys, end, "_at"], "left")
    return placed.withColumn(f"more_{end}", F.col("_next").isNotNull()).drop("_at", "_next")


def _taken_in_order(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The (keys, g, r, score) that the loop takes of ``edges``.

    An edge is taken iff both endpoints are free before it; an endpoint is free
    after an edge iff it was free before and the edge isn't taken. That is two
    literals a decision and three decisions an edge, however many edges an
    endpoint has. Decisions are numbered by what they are, g and r."""
    e = store(_with_previous(_with_previous(edges, keys, "g", "r"), keys, "r", "g"), "greedy-system")
    name = lambda kind, g, r: F.lit(kind << 60).bitwiseOR(F.shiftleft(g.cast("long"), 30)).bitwiseOR(r.cast("long"))
    g, r = F.col("g"), F.col("r")
    taken, of_g, of_r = name(0, g, r), name(1, g, r), name(2, g, r)
    before_g, before_r = name(1, g, F.col("before_r_of_g")), name(2, F.col("before_g_of_r"), r)
    e = e.withColumnsRenamed({"before_g": "before_r_of_g", "before_r": "before_g_of_r"})
    literal = lambda v, t, negated: F.struct(v.alias("v"), t.alias("t"), F.lit(negated).alias("negated"))
    nothing = F.lit(None).cast("long")
    rows = F.array(
        literal(taken, nothing, False), literal(taken, before_g, True), literal(taken, before_r, True),
        F.when(F.col("more_g"), literal(of_g, taken, False)), F.when(F.col("more_g"), literal(of_g, before_g, True)),
        F.when(F.col("more_r"), literal(of_r, taken, False)), F.when(F.col("more_r"), literal(of_r, before_r, True)),
    )
    literals = e.select(*keys, F.explode(rows).alias("l")).where("l IS NOT NULL").select(*keys, "l.*")
    values, open_ = settle(literals, keys)
    own = lambda rows: rows.where(F.col("v") < 1 << 60).select(*keys, F.shiftright("v", 30).cast("int").alias("g"), F.col("v").bitwiseAND(F.lit((1 << 30) - 1)).cast("int").alias("r"))
    among = lambda rows: edges.alias("e").join(rows.alias("t"), same_rows([*keys, "g", "r"], "e", "t"), "left_semi")
    taken = among(own(values.where("value")))
    if open_ is None:
        return taken
    taken, left = store(taken, "greedy-settled"), among(own(open_))
    for end in ("g", "r"):
        left = left.join(taken.select(*keys, end), [*keys, end], "left_anti")
    dealt = _component_of(left, F.xxhash64(F.lit("g"), *keys, "g"), F.xxhash64(F.lit("r"), *keys, "r"), "greedy-parts")
    dealt = dealt.repartition("_root").sortWithinPartitions("_root", F.col("score").desc(), "g", "r")
    return taken.unionByName(dealt.mapInPandas(_take_in_order(keys), _fields(edges, [*keys, "g", "r", "score"])))


def greedy_pairs(
    edges: DataFrame,
    keys: Sequence[str],
    threshold: float,
    g: str = "g",
    r: str = "r",
    score: str = "score",
) -> DataFrame:
    """Repeatedly take the best free pair (score desc, then lower g, then
    lower r) while its score is at least ``threshold``.

    Returns matched pairs ``(keys, g, r, score)``. Edges below the threshold
    can never be taken, so they are dropped first. An edge that is the best of
    both its ends is taken whatever else happens: a round takes all of those
    and drops their neighbours. The rest is settled as a system.
    """
    keys = list(keys)
    e = edges.select(*keys, F.col(g).cast("int").alias("g"), F.col(r).cast("int").alias("r"), F.col(score).cast("double").alias("score"))
    left = store(e.where(F.col("score") >= threshold), "greedy-edges")
    order = F.struct((-F.col("score")).alias("s"), "g", "r")
    parts = []
    for _ in range(ROUNDS):
        best_g = left.groupBy(*keys, "g").agg(F.min(order).alias("_bg"))
        best_r = left.groupBy(*keys, "r").agg(F.min(order).alias("_br"))
        both = left.join(best_g, [*keys, "g"]).join(best_r, [*keys, "r"]).where((order == F.col("_bg")) & (order == F.col("_br")))
        taken = store(both.select(*keys, "g", "r", "score"), "greedy-taken")
        parts.append(taken)
        left = left.join(taken.select(*keys, "g"), [*keys, "g"], "left_anti").join(taken.select(*keys, "r"), [*keys, "r"], "left_anti")
        left = store(left.select(*keys, "g", "r", "score"), "greedy-left")
    if not left.isEmpty():
        parts.append(_taken_in_order(left, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnsRenamed({"g": g, "r": r, "score": score})


def greedy_match(edges: DataFrame, keys: Sequence[str], threshold: float, g: str = "g", r: str = "r", score: str = "score") -> DataFrame:
    """``greedy_pairs`` with ``ord``, the acceptance order in each case."""
    keys, order = list(keys), [F.col(score).desc(), F.col(g), F.col(r)]
    taken = store(greedy_pairs(edges, keys, threshold, g, r, score), "greedy-result")
    most = taken.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= WINDOW_ROWS:
        return taken.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered_within(taken, keys, order, "ord").withColumn("ord", F.col("ord").cast("int"))


def match_metrics(
    cases: DataFrame,
    matched: DataFrame,
    keys: Sequence[str],
    generated: str = "generated_actions",
    reference: str = "reference_actions",
) -> DataFrame:
    """Per case matched / unmatched lists, P, R, F1, exact flag and mean
    score, with the empty-list rules of Q5.

    ``matched`` is the output of ``greedy_pairs`` with g / r indexes into the
    case's lists; per case it holds at most min(|gen|, |ref|) rows, so
    gathering it per case is bounded by the case row itself.
    """
    keys = list(keys)
    m = matched.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "g", "r", "score"))).alias("_pairs"),
        F.count("*").alias("_m"),
        F.sum("score").alias("_s"),
    )
    return match_columns(cases.join(m, keys, "left"), generated, reference)


def match_columns(c: DataFrame, generated: str, reference: str) -> DataFrame:
    """The columns of ``match_metrics`` from a case's matched ``_pairs``
    (s, g, r, score; in order), their number ``_m`` and summed score ``_s``."""
    gen, ref = F.coalesce(F.col(generated), F.array()), F.coalesce(F.col(reference), F.array())
    ng, nr = F.size(gen), F.size(ref)
    pairs = F.coalesce(F.col("_pairs"), F.array())
    mg = F.transform(pairs, lambda p: p["g"])
    mr = F.transform(pairs, lambda p: p["r"])
    n = F.coalesce(F.col("_m"), F.lit(0))
    both_empty = (ng == 0) & (nr == 0)
    one_empty = (ng == 0) | (nr == 0)
    p_one = F.when(ng == 0, 1.0).otherwise(0.0)
    r_one = F.when(nr == 0, 1.0).otherwise(0.0)
    prec = F.when(both_empty, 1.0).when(one_empty, p_one).otherwise(safe_div(n, ng))
    rec = F.when(both_empty, 1.0).when(one_empty, r_one).otherwise(safe_div(n, nr))
    out = c.select(
        "*",
        F.transform(pairs, lambda p: F.struct(
            F.element_at(gen, p["g"] + 1).alias("generated_action"),
            F.element_at(ref, p["r"] + 1).alias("reference_action"),
            p["score"].alias("score"),
        )).alias("matched_pairs"),
        F.transform(mg, lambda i: F.element_at(gen, i + 1)).alias("matched_generated_actions"),
        F.transform(mr, lambda i: F.element_at(ref, i + 1)).alias("matched_reference_actions"),
        F.transform(F.array_except(F.transform(gen, lambda _, i: i), mg), lambda i: F.element_at(gen, i + 1)).alias("unmatched_generated_actions"),
        F.transform(F.array_except(F.transform(ref, lambda _, i: i), mr), lambda i: F.element_at(ref, i + 1)).alias("unmatched_reference_actions"),
        n.alias("num_matched_actions"),
        prec.alias("action_precision"),
        rec.alias("action_recall"),
        F.when(both_empty, F.lit(1)).when(one_empty, F.lit(0)).otherwise(((n == ng) & (n == nr)).cast("int")).alias("exact_match"),
        F.when(both_empty, 1.0).when(one_empty | (n == 0), 0.0).otherwise(F.col("_s") / n).alias("average_match_score"),
        ng.alias("num_generated_actions"),
        nr.alias("num_reference_actions"),
    ).drop("_pairs", "_m", "_s")
    f1 = F.when(both_empty, 1.0).otherwise(
        safe_div(2 * F.col("action_precision") * F.col("action_recall"), F.col("action_precision") + F.col("action_recall"))
    )
    return (
        out.withColumn("action_f1", f1)
        .withColumn("num_unmatched_generated_actions", F.size("unmatched_generated_actions"))
        .withColumn("num_unmatched_reference_actions", F.size("unmatched_reference_actions"))
        .withColumn("decision", F.when(F.col("exact_match") == 1, "Correct").otherwise("Incorrect"))
    )


# -- T3: keep-first semantic de-duplication ------------------------------------


def redundancy_edges(
    items: DataFrame,
    keys: Sequence[str],
    threshold: float,
    idx: str = "idx",
    text: str = "text",
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Edges (keys, a, b), a < b, where the later action is redundant to the
    earlier one: min(fwd, bwd) >= t, or lexical overlap >= 0.5 and
    max(fwd, bwd) >= t.

    With the built-in token scorer both imply a token overlap of at least
    t * min(|a|, |b|), so candidates use tau = t and none is missed. Any other
    ``scorer`` (distinct text pairs in, ``forward`` / ``backward`` added) can
    call any two actions alike: the caller gives the ``candidates`` (keys, a,
    b) to score, and pairs outside them count as different."""
    keys = list(keys)
    if (scorer is None) != (candidates is None):
        raise ValueError("a scorer of the caller's needs the caller's candidates, and the other way round")
    tok = store(tokenize(items.select(*keys, idx, text), text), "dedup-items")
    if scorer is None:
        candidates = overlap_candidates(tok, None, keys, threshold, idx, text)
    pairs = attach_texts(candidates, tok, tok, keys, idx, text, with_text=scorer is not None)
    if scorer is None:
        pairs = pairs.withColumns({"forward": coverage("tok_b", "tok_a"), "backward": coverage("tok_a", "tok_b")})
    else:
        pairs = score_distinct_pairs(pairs, scorer)
    fwd, bwd = F.col("forward"), F.col("backward")  # candidate b vs kept a
    red = (F.least(fwd, bwd) >= threshold) | ((lexical_overlap("tok_a", "tok_b") >= 0.5) & (F.greatest(fwd, bwd) >= threshold))
    return pairs.filter(red).select(*keys, "a", "b")


def _remove_in_order(keys: list[str]) -> Callable:
    """Rows (case, b, a) by b: b is removed once an ``a`` of its is kept. All
    rows that decide ``a`` come before, as a < b."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, removed = None, set()
        for f in frames:
            new = []
            for at, a, b, *case in zip(f["_root"], f["a"], f["b"], *[f[k] for k in keys], strict=True):
                if at != root:
                    root, removed = at, set()
                gone = (a, *case) not in removed and (b, *case) not in removed
                if gone:
                    removed.add((b, *case))
                new.append(gone)
            yield f.loc[new, [*keys, "b"]].rename(columns={"b": "idx"})

    return run


def _removed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx) of the actions that a keep-first scan removes."""
    live = store(edges, "dedup-edges")
    parts = []
    for _ in range(ROUNDS):
        # What has no live earlier neighbour is kept, and its later ones go.
        later = live.select(*keys, F.col("b").alias("a")).distinct()
        gone = store(live.join(later, [*keys, "a"], "left_anti").select(*keys, F.col("b").alias("idx")).distinct(), "dedup-gone")
        parts.append(gone)
        for end in ("a", "b"):
            live = live.join(gone.withColumnRenamed("idx", end), [*keys, end], "left_anti")
        live = store(live.select(*keys, "a", "b"), "dedup-live")
    if not live.isEmpty():
        items = live.select(*keys, F.explode(F.array("a", "b")).alias("v")).select(*keys, F.col("v").cast("long"), F.lit(None).cast("long").alias("t"), F.lit(False).alias("negated"))
        literals = items.unionByName(live.select(*keys, F.col("b").cast("long").alias("v"), F.col("a").cast("long").alias("t"), F.lit(False).alias("negated")))
        values, open_ = settle(literals, keys)
        place = F.col("v").cast("int")
        parts.append(values.where(~F.col("value")).select(*keys, place.alias("idx")))
        if open_ is not None:
            # What a kept one is next to goes; the rest is decided in order.
            kept = values.where("value").select(*keys, place.alias("a"))
            gone = store(live.join(kept, [*keys, "a"]).join(open_.select(*keys, place.alias("b")), [*keys, "b"], "left_semi").select(*keys, F.col("b").alias("idx")).distinct(), "dedup-gone")
            parts.append(gone)
            for end in ("a", "b"):
                live = live.join(open_.select(*keys, place.alias(end)), [*keys, end], "left_semi").join(gone.withColumnRenamed("idx", end), [*keys, end], "left_anti")
            node = lambda c: F.xxhash64(*keys, c)
            dealt = _component_of(live.select(*keys, "a", "b"), node("a"), node("b"), "dedup-parts")
            dealt = dealt.repartition("_root").sortWithinPartitions("_root", *keys, "b", "a")
            parts.append(dealt.mapInPandas(_remove_in_order(keys), _fields(gone, [*keys, "idx"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def semantic_dedup(
    items: DataFrame,
    keys: Sequence[str],
    threshold: float,
    idx: str = "idx",
    text: str = "text",
    edges: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Keep-first scan; an action is removed when it is redundant to an
    earlier KEPT action. Returns ``items`` with ``status`` kept / removed.

    ``items`` should already be W6-distinct. ``edges`` (keys, a, b) may be
    supplied ready, or a ``scorer`` with its ``candidates``; by default the
    token scorer's edges are used. That scorer sees token sets only, so equal
    sets of a case share their fate: the first stands for all, and the later
    ones, redundant to it or to what removes it, always go.
    """
    keys = list(keys)
    same = None
    if edges is None and scorer is None:
        sets = store(
            items.select(*keys, idx, text, F.array_sort(tokens(text)).alias("tok")).withColumn("_set", F.xxhash64("tok")), "dedup-sets"
        )
        # No tokens: redundant to nothing.
        firsts = sets.where(F.size("tok") > 0).groupBy(*keys, "_set", "tok").agg(F.min(F.struct(idx, text)).alias("_f"))
        firsts = store(firsts.select(*keys, "_set", "tok", f"_f.{idx}", f"_f.{text}"), "dedup-firsts")
        first_of = firsts.select(*keys, "_set", "tok", F.col(idx).alias("_first"))
        same = sets.join(first_of, [*keys, "_set", "tok"]).where(F.col(idx) != F.col("_first")).select(*keys, F.col(idx).alias("idx"))
        edges = redundancy_edges(firsts.select(*keys, idx, text), keys, threshold, idx, text)
    elif edges is None:
        edges = redundancy_edges(items, keys, threshold, idx, text, scorer, candidates)
    removed = _removed(edges.select(*keys, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")), keys)
    if same is not None:
        removed = removed.unionByName(same.select(*keys, F.col("idx").cast("int")))
    flagged = removed.select(*keys, F.col("idx").alias(idx), F.lit(True).alias("_rm"))
    return items.join(flagged, [*keys, idx], "left").withColumn(
        "status", F.when(F.col("_rm"), "removed").otherwise("kept")
    ).drop("_rm")
