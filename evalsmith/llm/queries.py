"""Query bindings of the operators to the driver tables, with DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, hard_negatives, hilbert, mixing, pseudonyms, quality_classifier, quality_rules, simhash, token_counts, toxicity, url_filter, warc
from .common import table


#: The rules that op3 applies.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A deployment passes its own secret.
PSEUDONYM_KEY = "query-key"


def op1_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    labelled = quality_classifier.labelled_rows(docs, table(spark, sf_dir, "labels"), "quality", fold != 2)
    weights = quality_classifier.train(labelled)
    scored = quality_classifier.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    counts = [F.size(F.filter(F.col("pii")["kind"], _equals(k))).alias(f"n_{k}") for k in pseudonyms.KINDS]
    return out.select("doc_id", "text", F.size("pii").alias("n_found"), *counts)


def _equals(value: str):
    return lambda x: x == value


def op3_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, default="allow")
    j = F.col("judged")
    return out.select("page_id", j["host"].alias("host"), j["path"].alias("path"), j["rule"].alias("rule"), j["action"].alias("verdict"))


def op4_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leak = F.col("leak")
    return found.select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )


def op5_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard_by_curve(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index"
    )


def op7_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=1000)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("measures")
    return out.select(
        "doc_id",
        *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality_rules.passes("v1")).alias("base_failed"),
        quality_rules.passes("v2").alias("kept"),
        F.col("fail_bits"),
    )


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    m = mixing.mixed(rows, plan, F.col("h"))
    order = [F.col("first_time").asc_nulls_last(), F.col("__mix_order")]
    out = m.select(
        "doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"),
        (F.col("mix.copies") * F.col("size")).alias("taken"), F.element_at(F.array_append("mix.times", F.lit(None).cast("double")), 1).alias("first_time"), "__mix_order",
    )
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("__mix_order")


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    prior = toxicity.class_prior(labels, "toxic", fold != 1)
    weights = toxicity.train(toxicity.examples(docs, labels, "toxic", fold != 1), prior)
    scored = toxicity.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op12_l2ap_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


QUERIES = {
    "op1_ftrl_quality": op1_ftrl_quality,
    "op2_feistel_pii": op2_feistel_pii,
    "op3_url_trie": op3_url_trie,
    "op4_aho_corasick": op4_aho_corasick,
    "op5_rank_merge": op5_rank_merge,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_gzip_normaliser": op7_gzip_normaliser,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_nnpu_toxicity": op11_nnpu_toxicity,
    "op12_l2ap_negatives": op12_l2ap_negatives,
    "op13_divergence_audit": op13_divergence_audit,
}

#: Words of a text, lower-cased or not, in DuckDB.
_SPACED = r"[^\x20\x09-\x0D]+"

_OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, unnest(regexp_extract_all(text, '{_SPACED}')) AS word, generate_subscripts(regexp_extract_all(text, '{_SPACED}'), 1) AS i FROM d
), per AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid
), tri AS (
  SELECT * FROM (
    SELECT rid, i, word AS a, lead(word) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)
  ) WHERE c IS NOT NULL
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_SPACED}') GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN per USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 16 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM f
"""

_OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), grams AS (
  SELECT rid, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), hits AS (
  SELECT rid, item_id, i, g.n FROM grams g JOIN win USING (n, gram)
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

_OP3_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), u AS (
  SELECT DISTINCT host, path FROM p
), best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, max_by(action, length(rhost) * 1000 + length(rpath)) AS action
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)
"""

_OP7_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN best <> page_id THEN best END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM d
), g AS (
  SELECT DISTINCT lang, source FROM d
), per AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), kept AS (
  SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10
), full_ AS (
  SELECT g.lang, g.source, kept.term, coalesce(per.n, 0) AS n, ln FROM g JOIN kept USING (lang) LEFT JOIN per ON per.lang = g.lang AND per.source = g.source AND per.term = kept.term
), shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
    1 + (1000000000::HUGEINT * (ln + 2)) // (sum(ln) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q
  FROM full_
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP12_SQL = r"""
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), a AS (
  SELECT * FROM r WHERE vec_id % 100 = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM a JOIN r ON a.rid <> r.rid
), pos AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s WHERE same
), neg AS (
  SELECT p.rid, p.anchor_id, positive_id, positive_score, k, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.rid, k ORDER BY score DESC, s.vec_id) AS rank
  FROM pos p JOIN s ON s.rid = p.rid AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE k <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

ORACLES = {
    "op12_l2ap_negatives": _OP12_SQL,
    "op13_divergence_audit": _OP13_SQL,
    "op3_url_trie": _OP3_SQL,
    "op7_gzip_normaliser": _OP7_SQL,
    "op4_aho_corasick": _OP4_SQL,
    "op8_rule_ledger": _OP8_SQL,
}
