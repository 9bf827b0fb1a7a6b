"""Joins of a large table with one row per key, safe when one key holds much of the large side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has such a column (case doesn't count)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(big: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner", split: int = 1_000_000) -> DataFrame:
    """Join ``big`` with ``per_key`` (at most one row per key) on ``keys``, the rows of a heavy key spread over tasks.

    Keys are counted first, combined before the shuffle; one with more than ``split`` rows, or a 1,000th of all where that is
    more, is heavy, so there are at most 1,000 of them, and only their rows are salted and copied. The salt of a row is drawn
    from all its columns, so repeated rows stay together but different ones part. Null keys match nothing, as in any
    equi-join, and are parted, too. Column names other than the keys must differ. ``big`` is read twice, so what is dear to
    compute should have been written.
    """
    rows, salt, parts = (fresh(name, big, per_key) for name in ("_rows", "_salt", "_parts"))
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows))
    total = counts.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("all"), F.coalesce(F.max(rows), F.lit(0)).alias("most")).first()
    at = max(split, -(-total["all"] // 1000))
    if total["most"] <= at:
        return big.join(per_key, keys, how)
    found = counts.where(F.col(rows) > at).select(*keys, F.ceil(F.col(rows) / at).cast("int").alias(parts))
    heavy = F.broadcast(big.sparkSession.createDataFrame(found.collect(), found.schema))  # at most 1,000 rows
    drawn = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    unknown = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    salted = big.join(heavy, keys, "left").withColumn(salt, F.when(unknown, F.pmod(drawn, F.lit(1000))).otherwise(F.coalesce(F.pmod(drawn, F.col(parts)), F.lit(0))).cast("int")).drop(parts)
    copies = per_key.join(heavy, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return salted.join(copies, [*keys, salt], how).drop(salt)
