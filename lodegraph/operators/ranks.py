"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.storage import materialize


def distributed_row_number(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 by `order`, however large the group is.

    The rows are range-partitioned by (group, order), so a hot group spans several
    partitions. Each partition numbers its own rows; the counts of the partitions
    before it, one row for each (partition, group), give the offset. `order` should be
    total, else equal rows get any of their numbers. Null group values form a group.
    """
    ordered = df.repartitionByRange(*[F.col(g) for g in group], *order).sortWithinPartitions(*group, *order)
    placed = materialize(ordered.withColumn("_part", F.spark_partition_id()), "ranked")
    local = Window.partitionBy("_part", *group).orderBy(*order)
    sizes = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before > 0")
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before")
    numbered = placed.withColumn("_local", F.row_number().over(local))
    match = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = numbered.join(offsets, match, "left")
    number = (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)
    return joined.select(*df.columns, number)
