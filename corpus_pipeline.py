"""The corpus pipeline: documents to sharded training data in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns
where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsmith.llm import decontamination, hilbert, mixing, quality_rules, simhash
from evalsmith.llm.common import store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    return quality_rules.ledger(docs.select(*COLUMNS)).where(quality_rules.passes("v2")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest doc_id
    and, among equal ones, of the smallest text hash; of equal rows one."""
    return simhash.keep_first(docs.select(*COLUMNS), shingle=3, max_bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontamination.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.col("leak.n_hit") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in curriculum order."""
    return mixing.curriculum(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, curve index, shard and slot."""
    return hilbert.shard_by_curve(docs.select(*COLUMNS), shards=SHARDS)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SimHash's hash function and the Hilbert order have no SQL counterpart; the
#: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
