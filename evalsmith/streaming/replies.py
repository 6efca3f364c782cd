"""Incremental judging of replies as they land (Structured Streaming).

The reference scores a finished batch of replies. When replies are written
by many model workers over time, the same parsing (F1 / F2 / P11) can run
on each new file as it arrives: ``readStream`` over the reply folder,
stateless per-row parsing, and an idempotent per-batch append of the
predictions (K1). Metrics stay a batch job over the appended predictions
(they need every reply of a model), so no streaming aggregation state is
kept. The checkpoint location makes the stream exactly-once and restartable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.replies import guideline_reply_label, qa_reply_label
from ..operators.metrics import decision

REPLY_SCHEMA = "case_id string, model_name string, run_id string, label int, raw_output string"


def parse_reply_stream(replies: DataFrame, task: str = "guideline") -> DataFrame:
    """Per-row label parsing, usable on a streaming or a batch DataFrame."""
    parser = guideline_reply_label if task == "guideline" else qa_reply_label
    return replies.withColumn("predicted_label", parser(F.col("raw_output"))).withColumn("decision", decision())


def start_reply_stream(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    task: str = "guideline",
    schema: str = REPLY_SCHEMA,
    available_now: bool = False,
    max_files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Start the stream: new parquet reply files in ``source_dir`` become
    predictions appended under ``sink_dir`` partitioned by run and model.

    ``checkpoint_dir`` must be on shared storage (it holds the offsets).
    ``available_now`` processes what is there and stops (backfills, tests).
    """
    src = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )
    parsed = parse_reply_stream(src, task)
    writer = (
        parsed.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .partitionBy("run_id", "model_name")
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
