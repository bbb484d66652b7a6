"""Joins whose shape depends on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a table is sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Parts that a hot key is dealt to where the table is larger.
SALTS = 64


def join_few_keys(df: DataFrame, small: DataFrame, key: str, row_bytes: int, spread: str) -> DataFrame:
    """df with the columns of `small`, one row for each value of `key` (null is a value).

    df may have few, very unequal keys. Where `small`, counted here, keeps to
    BROADCAST_BYTES, it is broadcast and df stays where it is. Beyond that both sides are
    salted: rows of a key are dealt by the hash of the column `spread`.
    """
    right = small.withColumnRenamed(key, "_key")
    if small.count() * row_bytes <= BROADCAST_BYTES:
        return df.join(F.broadcast(right), df[key].eqNullSafe(right["_key"])).drop("_key")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = right.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    match = salted[key].eqNullSafe(copies["_key"]) & (salted["_salt"] == copies["_salt_of"])
    return salted.join(copies, match).drop("_key", "_salt", "_salt_of")
