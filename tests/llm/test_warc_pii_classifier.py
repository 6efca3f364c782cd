"""Archives, pseudonyms and the classifier: round trips, plain versions, held-out accuracy."""

import gzip
import hashlib
import os
import random
import re
import subprocess
import sys
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalsmith.llm import common, pseudonyms, quality_classifier, warc

from .conftest import prose

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(9)
    big, small = "<p>" + prose(rng, 400), "tiny"
    rows = [(i, f"http://h{i % 3}.org/{i}", rng.choice([big, small, "x" * 999, "x" * 1000, f"<b>{i}</b>" + prose(rng, 300)])) for i in range(80)]
    rows += [(200, None, None), (201, "", ""), (202, "http://a b\r\nc: d", big), (None, "u", big), (None, None, "z" * 3_000_000), (None, None, None)]
    rows += [(7, "again", big)] * 3 + [(300, "né", "你好 WARC/1.1\r\n\r\n \x00 🎉" * 100)] * 2 + [(None, "n", "n" * 1200)] * 2
    return spark.createDataFrame(rows, PAGES).repartition(5)


def test_records_come_back_as_written(spark, pages):
    got = warc.round_trip(pages.withColumn("payload", F.lit("clash")).withColumn("file", F.lit("clash")), with_payload=True).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    best = {}
    for p, h in rows:
        if len(h) >= 1000:
            best[h] = max(best.get(h, -1), -1 if p is None else p)
    digest = {hashlib.sha1(h).hexdigest(): h for _, h in rows}
    assert sorted((r["page_id"] or -1, r["payload_digest"], r["payload_bytes"]) for r in got) == sorted((p or -1, hashlib.sha1(h).hexdigest(), len(h)) for p, h in rows)
    responses = [r for r in got if r["record_type"] == "response"]
    for h in best:  # one response for each large payload, of the largest page
        own = [r for r in responses if digest[r["payload_digest"]] == h]
        assert [-1 if r["page_id"] is None else r["page_id"] for r in own] == [best[h]]
    for r in got:
        h = digest[r["payload_digest"]]
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == h and r["refers_to"] is None
        else:
            assert len(h) >= 1000 and (-1 if r["refers_to"] is None else r["refers_to"]) == best[h]


def test_normalised_files_and_sidecar(spark, pages, tmp_path):
    whole, split = str(tmp_path / "whole"), str(tmp_path / "split")
    written = warc.write_archives(pages, whole)
    index = warc.normalise(warc.plan_revisits(written), whole, split).collect()
    files = [f for f in os.listdir(split) if f.endswith(".gz")]
    assert len(index) == pages.count() and {r["file"] for r in index} == set(files)
    for f in files:
        raw = (tmp_path / "split" / f).read_bytes()
        lines = [x.split("\t") for x in (tmp_path / "split" / f"{f}.idx").read_text().splitlines()]
        assert [(int(a), int(c), int(d)) for a, _, c, d in lines] == sorted((r["nth"], r["offset"], r["length"]) for r in index if r["file"] == f)
        assert sum(int(x[3]) for x in lines) == len(raw)
        parts = [gzip.decompress(raw[int(c) : int(c) + int(d)]) for _, _, c, d in lines]
        assert all(p.startswith(b"WARC/1.1\r\n") and p.endswith(b"\r\n\r\n") for p in parts)
        assert b"".join(parts) == gzip.decompress(raw)


def test_reader_takes_any_chunks_and_members():
    made = [warc.response(str(i), f"http://x/{i}", os.urandom(1 + i * 997)) for i in range(20)]
    for data in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        path = f"/tmp/evalsmith-test-{os.getpid()}.gz"
        with open(path, "wb") as f:
            f.write(data)
        with open(path, "rb") as f:
            assert b"".join(r.whole() for r in warc.records(warc.inflated(f))) == b"".join(made)
        os.remove(path)
    every = b"".join(made)
    assert len(list(warc.records(every[i : i + 7] for i in range(0, len(every), 7)))) == 20
    with pytest.raises(ValueError):
        list(warc.records([every[:-10]]))


def test_archives_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def foreign(kind, block, *lines):
    head = "\r\n".join(["WARC/1.0", f"warc-type:{kind}", *lines, f"CONTENT-LENGTH:{len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    """Headers in any case, without blanks or folded, blocks that are no HTTP, names that are no pages."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    body = b"<html>" + b"payload " * 300
    first = [
        foreign("warcinfo", b"software: x\r\n", "WARC-Record-ID:<urn:uuid:0>", "Content-Type:application/warc-fields"),
        foreign("response", http + body, "warc-record-id: <urn:uuid:1>", "Content-Type:Application/HTTP; msgtype=response", "WARC-Target-URI:http://a/\r\n  folded"),
        foreign("resource", body, "WARC-Record-ID:<urn:uuid:2>", "Content-Type: text/html"),
        foreign("response", b"no header", "WARC-Record-ID:<urn:uuid:3>", "Content-Type: application/http"),
        foreign("metadata", b"", "WARC-Payload-Digest: md5:abc"),
    ]
    second = [foreign("response", http + body, "WARC-Record-ID:<urn:uuid:9>", "content-type: application/http", "WARC-Date: 2020-01-01T00:00:00Z"), b"\r\n" + foreign("response", http + b"small", "WARC-Record-ID:<urn:uuid:4>", "content-type: application/http")]
    os.makedirs(tmp_path / "in")
    for name, made in (("a.warc.gz", first), ("b.warc.gz", second)):
        (tmp_path / "in" / name).write_bytes(gzip.compress(b"".join(made)))
    files = spark.createDataFrame([("a.warc.gz",), ("b.warc.gz",)], "file string")
    listed = warc.survey(files, str(tmp_path / "in"))
    assert [(r["nth"], r["record_type"], r["page_id"], r["payload_bytes"]) for r in listed.where("file = 'a.warc.gz'").orderBy("nth").collect()] == [
        (0, "warcinfo", "urn:uuid:0", 13), (1, "response", "urn:uuid:1", len(body)), (2, "resource", "urn:uuid:2", len(body)), (3, "block", "urn:uuid:3", 9), (4, "metadata", None, 0)
    ]
    index = warc.normalise(files, str(tmp_path / "in"), str(tmp_path / "as-is"))
    for name, made in (("a", first), ("b", second)):
        (out,) = [f for f in os.listdir(tmp_path / "as-is") if f.startswith(name) and f.endswith(".gz")]
        raw = (tmp_path / "as-is" / out).read_bytes()
        rows = sorted((r["offset"], r["length"]) for r in index.where(F.col("file") == out).collect())
        assert [gzip.decompress(raw[a : a + n]) for a, n in rows] == [m.lstrip(b"\r\n") for m in made]
    split = str(tmp_path / "out")
    got = {r["page_id"]: r for r in warc.read_records(warc.normalise(warc.plan_revisits(listed), str(tmp_path / "in"), split), split, True, task_bytes=64).collect()}
    assert len(got) == 7 and got["urn:uuid:1"]["record_type"] == "revisit" and got["urn:uuid:1"]["refers_to"] == "urn:uuid:9"
    assert got["urn:uuid:1"]["payload_digest"] == got["urn:uuid:9"]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert got["urn:uuid:1"]["payload_bytes"] == len(body) and got["urn:uuid:1"]["url"] == "http://a/ folded"
    assert bytes(got["urn:uuid:9"]["payload"]) == body and got["urn:uuid:2"]["record_type"] == "resource"


def test_text_ids_and_clashing_columns(spark):
    big = "y" * 1500
    rows = [("b/é x", "u", big), ("9", "u", big), ("10", "u", big), (None, "u", big), ("", "u", "s"), ("a:b<c>", "u", "t")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    pages = pages.selectExpr("*", "1 AS payload", "'f' AS file", "3 AS nth", "4 AS offset", "'x' AS record_type", "0 AS best")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {("b/é x", "revisit", "10"), ("9", "revisit", "10"), ("10", "response", None), (None, "revisit", "10"), ("", "response", None), ("a:b<c>", "response", None)}


def test_archives_spread_over_tasks(spark):
    """A task an archive, and reading dealt by bytes, not by index rows."""
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 4000) AS html").repartition(8)
    folder, out = common.shared_path(spark, "warc-in"), common.shared_path(spark, "warc-out")
    index = warc.normalise(warc.plan_revisits(warc.write_archives(pages, folder)), folder, out)
    total = index.agg(F.sum("length")).first()[0]
    dealt = warc.read_records(index, out, task_bytes=total // 8).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(dealt) >= 8 and sum(dealt) == 400 and max(dealt) <= 200
    assert len({r["file"] for r in index.select("file").distinct().collect()}) == 8


def luhn(digits):
    d = [int(x) for x in reversed(digits)]
    return sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])


def card(body):
    return next(body + str(k) for k in range(10) if luhn(body + str(k)) % 10 == 0)


def iban(country, account):
    number = "".join(str(int(c, 36)) for c in f"{account}{country}00")
    return f"{country}{98 - int(number) % 97:02d}{account}"


def test_pseudonyms_keep_formats_and_links(spark):
    c, c13 = card("411111111111111"), card("400000000000")
    spaced = f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"
    acc = iban("GB", "WEST12345698765432")
    texts = [
        f"mail a.b+c@mail1.example.com, card {c}.", f"card {spaced} and {c}!!", f"{c} {c13}", "bad card 4111111111111112 stays",
        "ip 10.0.255.1 and 999.1.1.1 and 1.2.3.4.5", "on 2024-02-29 and 31.12.1999 and 29/02/2000", "no 2023-02-29, 2024-13-01, 31.04.2000",
        "ssn 123-45-6789 not 000-12-3456 666-12-3456 123-00-4567", "call +1 (974) 555-3436%%% or 974-555-3436", f"pay {acc} not GB00WEST12345698765432",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "", None, "nothing here", "12345 words 20241 3.14 7@", c, c,
        "x" * 200_000 + f" {c} " + "1" * 50_000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit("clash"))
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    new = [out[i]["text"] for i in range(len(texts))]
    kinds = [[p["kind"] for p in out[i]["pii"] or []] for i in range(len(texts))]
    assert kinds == [["email", "card"], ["card", "card"], ["card", "card"], [], ["ip"], ["date"] * 3, [], ["ssn"], ["phone"] * 2, ["iban"], ["secret"], [], [], [], [], ["card"], ["card"], ["card"]]
    other = new[15]
    assert other == new[16] != c and luhn(other) % 10 == 0 and len(other) == 16
    assert new[1] == f"card {other[:4]}-{other[4:8]}-{other[8:12]}-{other[12:]} and {other}!!"
    assert new[2].startswith(other) and luhn(new[2].split()[1]) % 10 == 0
    assert re.fullmatch(r"mail [a-z]\.[a-z]\+[a-z]@[a-z]{4}\d\.[a-z]{7}\.com, card \d{16}\.", new[0])
    for i in (3, 6, 11, 12, 13, 14):
        assert new[i] == texts[i]
    assert re.fullmatch(r"ip (?:\d{1,3}\.){3}\d{1,3} and 999\.1\.1\.1 and 1\.2\.3\.4\.5", new[4])
    y, d1, d2 = re.fullmatch(r"on (\S+) and (\S+) and (\S+)", new[5]).groups()
    date.fromisoformat(y)
    date(int(d1[6:]), int(d1[3:5]), int(d1[:2]))
    assert d1[2] == d1[5] == "." and d2[2] == d2[5] == "/"
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4} not 000-12-3456 666-12-3456 123-00-4567", new[7])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}%%% or \d{3}-\d{3}-\d{4}", new[8])
    made = new[9].split()[1]
    assert made != acc and iban("GB", made[4:]) == made and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", made)
    assert re.fullmatch(r'token = "[0-9a-f]{40}" x = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', new[10]) and new[10] != texts[10]
    assert new[17] == "x" * 200_000 + f" {other} " + "1" * 50_000
    back = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), "k", back=True)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == texts
    assert pseudonyms.pseudonymise(docs.where("doc_id = 15"), "other key").first()["text"] != other
    assert pseudonyms.pseudonymise(docs.limit(0), "k").count() == 0


def replaced(spark, texts):
    """(new text, kinds) of each text; all are turned back to what they were."""
    rows = lambda xs: spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")
    out = pseudonyms.pseudonymise(rows(texts), "k").orderBy("doc_id").collect()
    back = pseudonyms.pseudonymise(rows([r["text"] for r in out]), "k", back=True).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == list(texts)
    return [(r["text"], [p["kind"] for p in r["pii"]]) for r in out]


def test_card_or_iban_before_more_digits_or_capitals(spark):
    rng = random.Random(5)
    c, spaced, acc = "4111111111111111", "4111 1111 1111 1111", iban("ES", "21000418450200051332")
    grouped = " ".join(acc[i : i + 4] for i in range(0, 24, 4))
    tails = [" 12/25", " 123", "-123", " 77 5500000000000004", " 123-45-6789", " 10.0.0.1", " 31/12/1999", "/12/25", ""]
    for (new, kinds), old in zip(replaced(spark, [v + x for v in (c, spaced) for x in tails]), [v for v in (c, spaced) for _ in tails], strict=True):
        assert not new.startswith(old) and kinds[0] == "card"
        assert luhn(re.sub(r"\D", "", new[: len(old)])) % 10 == 0
    assert [k[1:] for _, k in replaced(spark, [c + x for x in tails])] == [[], [], [], ["card"], ["ssn"], ["ip"], ["date"], [], []]
    for new, kinds in replaced(spark, [f"{acc} USD", f"{grouped} USD", f"{grouped} PLEASE pay", f"{grouped} {grouped} USD"]):
        assert set(kinds) == {"iban"} and "1332" not in new
    # The result must not read as a longer card: turned back by replaced().
    many = [f"{b[:4]} {b[4:8]} {b[8:12]} {b[12:]} {rng.randrange(10, 1000)}" for b in (card(f"4{rng.randrange(10**14):014d}") for _ in range(200))]
    assert all(k == ["card"] for _, k in replaced(spark, many))


def test_secrets_in_capitals_and_of_any_length(spark):
    rng = random.Random(6)
    draw = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    upper, lower, long = draw(40, "0123456789ABCDEF"), draw(40, "0123456789abcdef"), draw(2000, letters)
    jwt = ".".join(draw(n, letters + "-_") for n in (36, 300, 43))
    found = {f'TOKEN = "{upper}"': r'TOKEN = "[0-9A-F]{40}"', f"Token ='{lower}'": "Token ='[0-9a-f]{40}'", f'API_KEY="{long}"': r'API_KEY="\w{2000}"', f'secret: "{jwt}"': r'secret: "[\w-]{36}\.[\w-]{300}\.[\w-]{43}"'}
    found[f'Password="{draw(30, letters)}=="'] = r'Password="\w{30}=="'
    found[f'key = "{draw(50_000, letters)}"'] = r'key = "\w{50000}"'
    for old, (new, kinds) in zip(found, replaced(spark, list(found)), strict=True):
        assert kinds == ["secret"] and new != old and re.fullmatch(found[old], new)
    # Few letters: the result must stay hexadecimal of its case, or not: turned back by replaced().
    few = [f'KEY="{draw(15, "0123456789")}{x}"' for x in "AFafGg" for _ in range(60)]
    assert all(k == ["secret"] for _, k in replaced(spark, few))


def test_dates_in_every_form(spark):
    forms = {
        "2024-01-05T10:00:00Z": r"(\d{4})-(\d\d)-(\d\d)T10:00:00Z", "12/25/1990": r"(?P<m>\d\d)/(?P<d>\d\d)/(?P<y>\d{4})", "1/25/1990": r"(?P<m>\d)/(?P<d>\d\d)/(?P<y>\d{4})",
        "25/12/1990": r"(?P<d>\d\d)/(?P<m>\d\d)/(?P<y>\d{4})", "2024-1-5": r"(\d{4})-(\d)-(\d)", "5.1.2024": r"(?P<d>\d)\.(?P<m>\d)\.(?P<y>\d{4})",
        "2024/1/31": r"(\d{4})/(\d)/(\d\d)", "2024-12-5": r"(\d{4})-(\d\d)-(\d)", "5/12/2024": r"(?P<d>\d)/(?P<m>\d\d)/(?P<y>\d{4})", "28.2.2023": r"(?P<d>\d\d)\.(?P<m>\d)\.(?P<y>\d{4})",
    }
    for old, (new, kinds) in zip(forms, replaced(spark, list(forms)), strict=True):
        m = re.fullmatch(forms[old], new)
        assert kinds == ["date"] and new != old and m, (old, new)
        g = m.groupdict()
        date(int(g.get("y") or m[1]), int(g.get("m") or m[2]), int(g.get("d") or m[3]))
    stay = ["2023-02-29T10:00:00Z", "13/32/1990", "2/30/1990", "2024-1-055", "2024-01-05x", "1.2.3.2024", "0/5/2024", "2024-0-1", "31.4.2000"]
    assert replaced(spark, stay) == [(x, []) for x in stay]
    days = [date.fromordinal(date(1900, 1, 1).toordinal() + 241 * i) for i in range(300)]
    every = [f.format(d=d.day, m=d.month, y=d.year) for d in days for f in ("{m}/{d}/{y}", "{d}.{m}.{y}", "{y}-{m}-{d}", "{m:02}/{d:02}/{y}")]
    assert all(k == ["date"] for _, k in replaced(spark, every))


@pytest.mark.parametrize("radices", [[10, 10], [17, 29], [3, 2, 5, 4], [7]])
def test_feistel_is_a_permutation(spark, radices):
    size = int(np.prod(radices))
    v, rest = [], F.col("id")
    for r in radices:
        v.append((rest % r).cast("int"))
        rest = F.floor(rest / r)
    values, rad = F.array(*v), F.array(*[F.lit(r) for r in radices])
    rows = spark.range(size).select(values.alias("v"), rad.alias("r")).withColumn("w", pseudonyms.feistel(F.col("v"), F.col("r"), "k", F.lit("t")))
    rows = rows.withColumn("back", pseudonyms.feistel(F.col("w"), F.col("r"), "k", F.lit("t"), back=True)).collect()
    assert len({tuple(r["w"]) for r in rows}) == size
    assert all(r["back"] == r["v"] and all(0 <= x < y for x, y in zip(r["w"], r["r"], strict=True)) for r in rows)


@pytest.fixture(scope="module")
def marked(spark):
    """Clean prose, and junk of three kinds, with labels for two thirds."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(20, 150), 3000).split(" ")
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else " | ".join(words).split(" ")
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_on_held_out_rows(marked):
    docs, labels = marked
    weights = quality_classifier.train(quality_classifier.labelled_rows(docs, labels, "quality", F.col("doc_id") % 2 == 0), bits=14)
    rows = quality_classifier.score(docs.withColumn("score", F.lit("clash")), weights, bits=14).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_bound_and_odd_tables(spark, marked, odd_docs, no_docs):
    docs, labels = marked
    few = quality_classifier.labelled_rows(docs, labels, "quality", F.lit(True), max_train=50)
    assert few.count() == 50
    more = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (4, 1)], "doc_id long, quality int"))
    every = quality_classifier.labelled_rows(docs, more, "quality", F.lit(True))
    assert every.count() == labels.count()
    weights = quality_classifier.train(few, bits=12, passes=1)
    same = quality_classifier.train(few, bits=12, passes=1)
    assert np.array_equal(weights, same)
    rows = quality_classifier.score(odd_docs, weights, bits=12).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert quality_classifier.score(no_docs, weights, bits=12).count() == 0
    none = quality_classifier.train(quality_classifier.labelled_rows(docs, labels.limit(0), "quality", F.lit(True)), bits=12)
    assert {r["score"] for r in quality_classifier.score(docs, none, bits=12).collect()} == {0.5}


def vectors_plain(text):
    """Distinct single tokens and pairs of a text."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+", text.encode())
    return {*tokens, *zip(tokens, tokens[1:], strict=False)}


def test_vectors_have_an_entry_per_ngram():
    texts = ["", "a", "a b a b", "x!! y!! Zé-1", "  \n", "b a", "word%%% word%%%"]
    rows, at, x = quality_classifier.Vectors(22)(texts)
    for i, t in enumerate(texts):
        assert (rows == i).sum() == len(vectors_plain(t))
        assert not t.strip() or np.sum(x[rows == i] ** 2) == pytest.approx(1)
    alone = [quality_classifier.Vectors(22)([t]) for t in texts]
    assert np.array_equal(np.concatenate([a[1] for a in alone]), at)


def test_pipeline_stages(spark, odd_docs, tmp_path):
    import corpus_pipeline

    from .test_simhash_mix_shards import components_plain, fingerprint_plain
    from .test_rules_leaks_tokens import leaks_plain, rules_plain

    rng = random.Random(30)
    leak = prose(rng, 14, 900)
    fresh = [(5000 + i, prose(rng, 120, 900) + (f" {leak}" if i % 9 == 0 else ""), "en", rng.choice("ab"), 1) for i in range(70)]
    copies = [(6000 + i, fresh[i][1] + " ", "en", "c", 1) for i in range(20)] + [(7000, fresh[1][1].replace(" ", "### "), "en", "a", 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(fresh + copies, odd_docs.schema))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = common.store(stage(spark, now, folder), "test-stage")
        kept[name] = (before, now.collect())
        if name != "sharding":
            assert now.columns == corpus_pipeline.COLUMNS
    before, after = kept["quality_rules"]
    def good(t):
        n, chars, symbols, lines, dup, rep, up, letters = rules_plain(t)
        return n >= 50 and rep * 100 <= 50 * n and 10 * symbols <= 3 * n and 2 * dup <= lines and 2 * up <= letters and 2 * n <= chars <= 25 * n
    assert sorted(after, key=str) == sorted((r for r in before if good(r["text"])), key=str)
    before, after = kept["simhash_near_dedup"]
    group, first = components_plain(before)
    assert len(after) == len(set(group.values()))
    assert {group[fingerprint_plain(r["text"])]: r["doc_id"] for r in after} == dict(first) | {g: None for g in group.values() if first[g] is None}
    before, after = kept["benchmark_decontamination"]
    assert sorted(after, key=str) == sorted((r for r in before if not leaks_plain(r["text"], [(1, leak)])[1]), key=str)
    before, after = kept["mixing"]
    assert {str(r) for r in after} <= {str(r) for r in before} and max(after.count(r) for r in after) <= 2
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    largest = max(len(r["text"].split()) for r in before)
    assert abs(words(after) - 1.5 * words(before)) <= 1.5 * largest * len({r["source"] for r in before})
    before, after = kept["sharding"]
    assert sorted(r["doc_id"] or -1 for r in before) == sorted(r["doc_id"] or -1 for r in after)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, after))


def test_entry_without_the_subpackage(tmp_path):
    """The driver removes this subpackage, its tests and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import shutil

    for name in ("evalsmith", "__spark_entry__.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = r"import __spark_entry__ as e; q = e.queries(); import re; assert q and not [k for k in q if re.match(r'op\d+_|pipeline', k)]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_values_that_other_text_hid(spark):
    """Numbers before cards, names with quotes, blanks and no quotes, small
    letters; an independent finder sees none of the values again."""
    c, other = card("411111111111111"), card("550000000000000")
    fours = " ".join(c[i : i + 4] for i in range(0, 16, 4))
    acc = iban("DE", "370400440532013000")
    spaced = " ".join(acc[i : i + 4] for i in range(0, len(acc), 4))
    token = "9233a8ec04dbebab91ab85687d33eeaaf9ac699e"
    hidden = [
        (f"order 12345 {fours}", fours, "card"), (f"2024 {fours} end", fours, "card"), (f"123 {c}", c, "card"), (f"7 8 99 {fours} 12/25", fours, "card"), (f"nr 12345 {other}.", other, "card"),
        (f'{{"token": "{token}"}}', token, "secret"), (f"api_key  =  '{token}'", token, "secret"), (f"export TOKEN={token.upper()}", token.upper(), "secret"), (f"{{'my_secret' : '{token}'}}", token, "secret"),
        (f"password: {token}", token, "secret"), (spaced.lower(), spaced.lower(), "iban"), (f"pay {acc.lower()} now", acc.lower(), "iban"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(hidden)], "doc_id long, text string")
    out = pseudonyms.pseudonymise(docs, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, (text, value, kind) in enumerate(hidden):
        new = rows[i]["text"]
        assert value not in new and len(new) == len(text), (text, new)
        assert [p["kind"] for p in rows[i]["pii"]] == [kind], (text, new)
        at = text.index(value)
        got = rows[i]["pii"][0]["value"]
        assert new == text[:at] + got + text[at + len(value) :]
        bare = re.sub("[ -]", "", got)
        if kind == "card":
            assert luhn(bare) % 10 == 0 and re.sub(r"\d", "0", got) == re.sub(r"\d", "0", value)
        elif kind == "iban":
            assert int("".join(str(int(x, 36)) for x in bare[4:] + bare[:4])) % 97 == 1 and got == got.lower()
        else:
            assert re.fullmatch("[0-9a-f]{40}" if value.islower() else "[0-9A-F]{40}", got)
    back = pseudonyms.pseudonymise(out.select("doc_id", "text"), "k", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t for i, (t, _, _) in enumerate(hidden)}
    clean = ["the key = internationalization of it", "token is here", "password: short", "key: 12345", "1234 5678 9012 3456 7890"]
    same = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), "k")
    assert [r["text"] for r in same.orderBy("doc_id").collect()] == clean
