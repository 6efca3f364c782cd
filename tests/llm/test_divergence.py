import collections
import re

import pytest

from evalsmith.llm import divergence

from .conftest import SCHEMA


def audit_plain(rows, least, top):
    """The audit by its definition, term by term and pair by pair."""
    docs = [(r["lang"] or "", r["source"] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")) for r in rows]
    docs = [(a, b, ["".join(c.lower() if c.isascii() else c for c in w) for w in ws]) for a, b, ws in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        count = collections.defaultdict(collections.Counter)
        for _, s, ws in own:
            count[s].update(w for w in ws if w in df)
        every = sum(count.values(), collections.Counter())

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1000000000 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        of, q = {s: shares(count[s]) for _, s, _ in own}, shares(every)
        far = lambda x, y: (x - y) ** 2 // (x + y)
        for s in of:
            pairs = [(sum(far(of[s][w], of[h][w]) for w in kept), h) for h in of if h != s]
            terms = [(far(of[s][w], q[w]), w) for w in kept if count[s][w] and of[s][w] > q[w]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, top)):
                listed = sorted(listed, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(listed)]
    return sorted(out)


def audited(docs, **how):
    out = divergence.audit(docs, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("least,top,bits", [(2, 10, 64), (3, 2, 64), (2, 10, 5), (1000, 10, 64)])
def test_audit_of_odd_rows(odd_docs, least, top, bits):
    """Also with digests of 5 bits, which most terms share."""
    assert audited(odd_docs, least_docs=least, top=top, bits=bits) == audit_plain(odd_docs.collect(), least, top)


def test_audit_flushes_and_splits_terms_over_frames(odd_docs, monkeypatch):
    for name, n in (("_HELD", 50), ("_ROWS", 7), ("_PAIRED", 40), ("_BROADCAST", 3)):
        monkeypatch.setattr(divergence, name, n)
    assert audited(odd_docs, least_docs=2) == audit_plain(odd_docs.collect(), 2, 10)


def test_audit_of_clashing_columns_and_no_rows(spark, odd_docs, no_docs):
    clash = odd_docs.selectExpr("*", "1 AS gid", "2 AS lid", "'x' AS digest", "3 AS n", "4 AS value", "5 AS rank", "'t' AS term")
    assert audited(clash, least_docs=2) == audited(odd_docs, least_docs=2)
    assert audited(no_docs) == []
    alone = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert audited(alone) == []


def test_query(spark, odd_docs, tmp_path):
    from evalsmith.llm.queries import QUERIES

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_divergence_audit"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in out.collect()) == audit_plain(odd_docs.collect(), 10, 10)
