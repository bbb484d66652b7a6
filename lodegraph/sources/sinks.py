"""Sinks: tables that are replaced by partition or merged by key, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodegraph.operators.frames import keep_latest
from lodegraph.storage import materialize


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite the partitions that df has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_table(df: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert by key. The merged table is complete in the scratch folder before the stored
    one is replaced."""
    spark = df.sparkSession
    stored = spark.read.parquet(path)
    merged = materialize(keep_latest(stored, df.select(*stored.columns), keys), "merged")
    merged.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
