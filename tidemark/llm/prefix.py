"""Running positions within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def positions(df: DataFrame, key: list[str], identity: list[str], size: Column, parts: int) -> DataFrame:
    """``df`` with ``_before``: the sum of ``size`` over the rows before it in its key, in an order drawn by hashing.

    Each key's rows are hashed by ``identity`` into ``parts`` parts, so a hot key is many tasks' work; only the sums
    of parts meet, one row each. The order within a part is the hash, then identity. Rows that repeat an identity
    come next to each other. ``df`` is read twice and should be cheap to read again.
    """
    spread = df.withColumn("_h", F.xxhash64(*identity)).withColumn("_size", size).withColumn("_part", F.pmod(F.col("_h"), F.lit(parts)))
    sums = spread.groupBy(*key, "_part").agg(F.sum("_size").alias("_sum"))
    before = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*key, "_part").orderBy("_h", *identity).rowsBetween(W.unboundedPreceding, -1)
    placed = spread.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return placed.join(offsets, [*key, "_part"]).withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_h", "_size", "_part", "_inside", "_offset")
