"""Sinks (K1-K4): results are appended by column name into partitioned
parquet; nested records go to JSONL; flat exports to CSV with list columns
as JSON text. Writes are Spark jobs: every task writes its own files and
the commit protocol makes a retried task safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_PARTITIONS = ("run_id", "model_name")


def with_dataset(df: DataFrame, path: str, column: str = "dataset") -> DataFrame:
    """The data set a result belongs to, from its input's file name: one
    whose stem has ``_adv`` or ends in ``adv`` is ``adversarial``, any other
    ``vignette``. The sinks keep the two apart by this column."""
    stem = path.rstrip("/").rpartition("/")[2].rpartition(".")[0] or path.rstrip("/").rpartition("/")[2]
    adversarial = "_adv" in stem.lower() or stem.lower().endswith("adv")
    return df.withColumn(column, F.lit("adversarial" if adversarial else "vignette"))


def _partitions(df: DataFrame, partition_by: Sequence[str]) -> list[str]:
    parts = [c for c in partition_by if c in df.columns]
    if "dataset" in df.columns and "dataset" not in parts:
        parts.append("dataset")
    return parts


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = RESULT_PARTITIONS) -> None:
    """K1: append predictions / summaries / diagnostics by column name,
    partitioned by run and model (and ``dataset`` when present, P13)."""
    df.write.mode("append").partitionBy(*_partitions(df, partition_by)).parquet(path)


def replace_results(df: DataFrame, path: str, partition_by: Sequence[str] = RESULT_PARTITIONS) -> None:
    """K2: replace the partitions this run writes, keep the others. Without a
    partition column the whole path would go, which is an error."""
    parts = _partitions(df, partition_by)
    if not parts:
        raise ValueError(f"none of {list(partition_by)} is a column: nothing names the partitions to replace")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: nested rows to JSONL, null fields kept as null keys."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: flat CSV; nested (array / struct / map) columns as JSON text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode(mode).option("header", True).option("escape", '"').csv(path)
