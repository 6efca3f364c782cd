"""Readers for records, CSV tables, descriptor XML, ordered logs and saved
predictions (S1, S2, S7, S9, S10). All are Spark data sources with declared
schemas; nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip

MESH_SCHEMA = T.StructType(
    [
        T.StructField("DescriptorName", T.StructType([T.StructField("String", T.StringType())])),
        T.StructField("TreeNumberList", T.StructType([T.StructField("TreeNumber", T.ArrayType(T.StringType()))])),
    ]
)

# Keys an optimizer log line may carry.
LOG_KEYS = ["msg", "message", "text", "_backward_through_llm", "prompt", "optimizer.response", "parameter.value"]


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, jsonl: bool | None = None) -> DataFrame:
    """A JSON array, a single JSON object or JSONL (blank lines skipped)
    into rows with a declared schema; malformed input fails the job.

    ``jsonl`` defaults from the extension (``.jsonl`` is line-delimited).
    """
    if jsonl is None:
        jsonl = path.rstrip("/").endswith(".jsonl")
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", not jsonl).json(path)


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, embedded newlines and doubled quotes (the
    pandas default); text such as ``N/A`` stays text."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_mesh_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor name and tree numbers from the subject-heading XML,
    with the file position so the first duplicate can win."""
    x = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(MESH_SCHEMA).load(path)
    return x.select(
        F.col("DescriptorName.String").alias("name"),
        F.coalesce(F.col("TreeNumberList.TreeNumber"), F.array().cast("array<string>")).alias("tree_numbers"),
        F.monotonically_increasing_id().alias("file_pos"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An ordered JSONL log, one row per line that is a JSON object.

    Lines are read in parallel (files are split by byte range); the order
    within each file is kept by ``line_no``, an id that increases with file
    position. Blank, malformed and non-object lines are skipped (Q19);
    ``message`` is ``msg``, or ``message`` when ``msg`` is empty.
    """
    raw = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value")
    )
    v = F.try_parse_json(py_strip(F.col("value")))
    kind = F.upper(F.substring(F.schema_of_variant(v), 1, 6))
    parsed = raw.select("file", "line_no", v.alias("v")).filter(F.col("v").isNotNull() & (kind == "OBJECT"))
    cols = [F.try_variant_get(F.col("v"), f"$['{k}']", "string").alias(k) for k in LOG_KEYS]
    return parsed.select("file", "line_no", *cols)


def read_predictions(df: DataFrame, list_cols: list[str]) -> DataFrame:
    """Decode JSON list cells of saved predictions; null, blank or
    malformed cells give an empty list. ``original_reference_actions`` is
    backfilled from ``reference_actions`` when absent."""
    out = df
    for c in list_cols:
        if c not in out.columns:
            continue
        parsed = F.try_variant_get(F.try_parse_json(F.col(c)), "$", "array<string>")
        out = out.withColumn(c, F.coalesce(parsed, F.array().cast("array<string>")))
    if "original_reference_actions" not in out.columns and "reference_actions" in out.columns:
        out = out.withColumn("original_reference_actions", F.col("reference_actions"))
    return out


def read_matched_pairs(df: DataFrame, col: str = "matched_pairs") -> DataFrame:
    """S10 for the pair list cell: JSON list of {generated_action,
    reference_action, score}; bad cells give an empty list."""
    t = "array<struct<generated_action:string,reference_action:string,score:double>>"
    parsed = F.try_variant_get(F.try_parse_json(F.col(col)), "$", t)
    return df.withColumn(col, F.coalesce(parsed, F.array().cast(t)))
