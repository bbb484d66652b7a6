"""Small relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by `order`."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every key by `order`, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: empty where they are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df without a partner in other: a broken reference, or work to be done."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def keep_latest(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def classify_changes(stored: DataFrame, incoming: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """(keys, change) with change one of inserted, updated, unchanged and deleted."""
    s = stored.select(*keys, F.col(hash_col).alias("_old"), F.lit(True).alias("_s"))
    i = incoming.select(*keys, F.col(hash_col).alias("_new"), F.lit(True).alias("_i"))
    change = F.when(F.col("_s").isNull(), "inserted").when(F.col("_i").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return s.join(i, keys, "full").select(*keys, change.alias("change"))
