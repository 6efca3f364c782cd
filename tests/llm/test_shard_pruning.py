import random

from pyspark.sql import functions as F

from evalsmith.llm import hilbert

from .conftest import SCHEMA


def test_a_filter_on_two_dimensions_reads_few_shards(spark):
    """Runs of the curve keep neighbours in every dimension together; shards
    dealt at random would nearly all hold something of each pair."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(1, 3000), f"l{rng.randrange(6)}", f"s{rng.randrange(8)}", 1) for i in range(4800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = hilbert.shard_by_curve(docs, shards=48).select("doc_id", "shard").join(docs.select("doc_id", "lang", "source"), "doc_id")
    read = placed.groupBy("lang", "source").agg(F.countDistinct("shard").alias("shards"))
    mean, pairs = read.agg(F.avg("shards"), F.count("*")).first()
    assert pairs == 48 and mean < 48 / 4
    narrow = placed.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").where("n < 300").groupBy("lang").agg(F.countDistinct("shard").alias("shards"))
    assert narrow.agg(F.avg("shards")).first()[0] < 48 / 3


def test_pipeline_of_no_documents(spark, no_docs, tmp_path):
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprint_of_very_long_texts(spark):
    from evalsmith.llm import simhash

    from .test_simhash_mix_shards import fingerprint_plain

    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (20_000, 70_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.near_duplicates(docs.withColumn("fp", F.lit("clash"))).collect()}
    assert got == {i: fingerprint_plain(t) % (1 << 64) for i, t in enumerate(texts)}
