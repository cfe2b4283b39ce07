"""Sorted scans over range partitions whose groups may span several partitions.

A hash-partitioned window puts a whole group into one task; a group that holds a third of all rows then
stalls the job. Here rows are range-partitioned by (group, order), so a big group spreads over as many
partitions as its size needs. Callers scan each partition by batches; what a group needs from the partitions
before or after is a few values a partition, which is all the driver sees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed, parallelism


def range_sorted(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Rows in range partitions of ``keys``, sorted within each, materialised so that two scans see the same cuts.

    Adds ``_part``, the partition's number. The sort is Spark's external one, so a partition may exceed memory.
    """
    n = partitions or parallelism(df)
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    return checkpointed(out)


def numbered(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(number, key): rows numbered 0, 1, ... in the order of their key, without a window over all of them.

    A row's number is its place in its range partition plus the rows of those before, of which one count a
    partition is summed.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    n = partitions or parallelism(df)
    table = checkpointed(df.select(key).repartitionByRange(n, key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("_part"), place.alias("_place")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return table.join(F.broadcast(starts), "_part").select((F.col("_before") + F.col("_place")).alias("number"), key)  # a row a partition
