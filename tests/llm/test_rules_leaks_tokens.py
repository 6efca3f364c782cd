"""Quality rules, decontamination, token counts and URL filters against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalsmith.llm import decontamination, quality_rules, token_counts, url_filter

from .conftest import prose


def rules_plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered),
        len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)),
    )


def test_measures_equal_the_plain_ones(odd_docs):
    for r in odd_docs.collect():
        assert quality_rules.measure_text(r["text"] or "") == rules_plain(r["text"])
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \n\t#Aé\x0b\x1c\x85 ") for _ in range(rng.randrange(60)))
        assert quality_rules.measure_text(text) == rules_plain(text), repr(text)


def test_ledger_bits_policies_and_ablations(spark, odd_docs, no_docs):
    made = quality_rules.ledger(odd_docs.withColumn("measures", F.lit("clash")).withColumn("fail_bits", F.lit("clash")))
    rows = made.withColumn("kept", quality_rules.passes("v2")).withColumn("base", quality_rules.passes("v1")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        n, _, symbols, lines, dup, rep, up, letters = m = rules_plain(r["text"])
        assert tuple(r["measures"]) == m
        want = (n < 50) * 1 + (100 * rep > 50 * n) * 2 + (10 * symbols > 3 * n) * 4 + (2 * dup > lines) * 8 + (2 * up > letters) * 16 + (m[1] < 2 * n or m[1] > 25 * n) * 32
        assert r["fail_bits"] == want
        assert r["kept"] == (want == 0) and r["base"] == (want & 3 == 0)
    bits = [r["fail_bits"] for r in rows]
    for a in quality_rules.ablations(made).collect():
        mask = quality_rules.mask_of(quality_rules.POLICIES[a["policy"]])
        bit = quality_rules.mask_of([a["rule"]])
        assert a["n_docs"] == len(bits)
        assert a["n_fail"] == sum(b & bit != 0 for b in bits)
        assert a["n_fail_alone"] == sum(b & mask == bit for b in bits)
        assert a["n_kept"] == sum(b & mask == 0 for b in bits)
    assert quality_rules.ledger(no_docs).count() == 0


def leaks_plain(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(len(w), window)
        if not n:
            continue
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        at = [i for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in grams]
        if at:
            hit |= {i + k for i in at for k in range(n)}
            found |= {str(item_id)} - {"None"}
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks_equal_the_plain_ones(spark, odd_docs, no_docs, block_bytes):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(1, 40), 60)) for i in range(12)]
    items += [(50, None), (51, ""), (52, "two Words"), (None, "w1 w2 w3"), (3, items[3][1]), (53, "--"), (54, "Ünïcödé 你好")]
    texts = []
    for i in range(60):
        part = rng.choice(items)[1] or ""
        cut = rng.randrange(0, 12)
        texts.append(f"{prose(rng, 30, 60)} {'!! '.join(part.upper().split(' ')[cut:])} {prose(rng, 20, 60)}-two words,")
    docs = odd_docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "z", 1) for i, t in enumerate(texts)], odd_docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("leak", F.lit(1))
    for r in decontamination.find_leaks(docs.withColumn("leak", F.lit(1)), bench, block_bytes=block_bytes).collect():
        n, hit, found = leaks_plain(r["text"], items)
        assert (r["leak"]["n_words"], r["leak"]["n_hit"], list(r["leak"]["items"])) == (n, hit, found)
        inside = " ".join((r["text"] or "")[s["start"] : s["stop"]] for s in r["leak"]["spans"])
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", inside)) == hit
    assert decontamination.find_leaks(no_docs, bench).count() == 0
    clean = decontamination.find_leaks(odd_docs, bench.limit(0)).select("leak.*")
    assert clean.where("n_hit > 0 or size(items) > 0").count() == 0


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_the_library(library):
    path, tokenizer = library
    counter = token_counts.TokenCounter(token_counts.load_vocabulary(path))
    rng = random.Random(5)
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext|", "aaaaaaaa" * 900, "你好世界" * 300, "=-" * 4000, "'s", "\n's x", "''s", "it's't", "x's  y", "a\0b", "\0"]
    texts += ["".join(rng.choice("ab's tremvld  \n\t'1٣é你'. !\0\x85　🎉") for _ in range(rng.randrange(50))) for _ in range(4000)]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counter(texts) == want
    assert counter(texts[::-1]) == want[::-1]


def test_token_counts_of_odd_tables(odd_docs, no_docs, library):
    path, tokenizer = library
    rows = token_counts.count_tokens(odd_docs.withColumn("n_tokens", F.lit("clash")), path).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(no_docs, path).count() == 0


def judge_plain(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h.split(".")), len(p), a, h + p) for a, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("broadcast_rules", [100, 2])
def test_urls_equal_the_plain_ones(spark, broadcast_rules):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "com", "x.com", "Example.ORG", "", "org:80", "example.org."]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/14/x", "/es/", "//", "/en//1"]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "org", "/"), ("block", "", "/"), ("allow", "a.example.org", ""), ("allow", "org", "/")]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "https://www.", "") for h in hosts for p in paths for q in ("", "?a=/es/", "#/x")]
    urls += [None, "", "://", "no url", "http://", "a://b://c/d", "http://org\n/x"]
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)], "page_id long, url string").withColumn("judged", F.lit(0)).withColumn("host", F.lit(0))
    for r in url_filter.judge_urls(df, rules, broadcast_rules=broadcast_rules).collect():
        j = r["judged"]
        assert (j["host"], j["path"], j["rule"], j["action"]) == judge_plain(r["url"], rules), r["url"]
    assert url_filter.judge_urls(df, []).where("judged.action != 'allow' or judged.rule is not null").count() == 0
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
