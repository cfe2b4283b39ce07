"""Only rows that a set of keys may meet are shuffled: a broadcast of prefixes of the keys' hashes tells the others.

At most 2^``PREFIX`` prefixes are broadcast, however many keys there are. What they let pass is settled by an exact join
or aggregate, so no result depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 20  # bits of a hash


def _prefix(hashed: Column, bits: int | None) -> Column:
    return F.shiftrightunsigned(hashed, 64 - (bits or PREFIX))


def that_meet(rows: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """Rows whose key is among the keys, and some others."""
    told = keys.select(_prefix(F.xxhash64(key), bits).alias("_x")).distinct()
    return rows.withColumn("_x", _prefix(F.xxhash64(key), bits)).join(F.broadcast(told), "_x", "left_semi").drop("_x")


def last_of(rows: DataFrame, key: str, cols: list[str], order: list[str], bits: int | None = None) -> DataFrame:
    """The columns of each key's last row in the order; rows of a key that no other row has are not shuffled."""
    h = F.xxhash64(key)
    several = rows.groupBy(h.alias("_h")).agg(F.count("*").alias("_n")).where("_n > 1").select(_prefix(F.col("_h"), bits).alias("_x")).distinct().withColumn("_several", F.lit(True))
    told = rows.withColumn("_x", _prefix(h, bits)).join(F.broadcast(several), "_x", "left")
    last = told.where("_several").groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_l")).select("_l.*")
    return told.where("_several is null").select(*cols).unionByName(last)
