"""A 0-based position over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import written


def global_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """``df`` with its position in ``order``, which should be total. Rows are range-partitioned and numbered within
    their range; only one count per range is summed up. An empty table stays empty."""
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the exchange.
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_within")).drop("_range", "_within", "_offset")


def running_sums(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with running sums (inclusive) of columns along ``order`` within ``keys``; ``columns`` maps new name to column.

    Rows are range-partitioned by (keys, order), summed within their range, and ranges of a key offset by the totals of
    the ones before, so one key with most of the rows is many tasks' work. (keys, order) should identify a row. Nulls
    count as 0.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    group = [*keys, "_range"]
    sums = ranged.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{n}") for n, c in columns.items()])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*group, *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in columns])
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in columns.items()])
    same = [rows[g].eqNullSafe(offsets[g]) for g in group]
    joined = rows.join(offsets, same)
    return joined.select(*[rows[c] for c in df.columns], *[(rows[n] + offsets[f"_{n}"]).alias(n) for n in columns])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column per share): quantiles of a value, linear between ranks; nulls and NaN don't count.

    Equal values are counted first, then positions are running sums over ranges of values: no task holds all values of a
    key. ``shares`` maps a column's name to its share. Keys without values, and null keys, give no row.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # Without keys all ranges belong to one constant.
    group = keys or ["_one"]
    counts = counts if keys else counts.withColumn("_one", F.lit(1))
    placed = running_sums(counts, group, ["_v"], {"_upto": "_c"})
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_n"))
    wanted = sizes.select(*group, "_n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("at")) for name, q in shares.items()])).alias("w")).select(*group, "w.name", F.col("w.at").alias("_at"))
    # A value covers the ranks from _upto - _c to _upto - 1; a quantile lies between two of them. Few rows per key meet each value.
    wide = wanted.groupBy(*group).agg(F.collect_list(F.struct("name", "_at")).alias("_w"))
    hits = placed.join(wide, group).select(*group, "_v", "_upto", "_c", F.explode("_w").alias("w")).where((F.col("_upto") > F.floor("w._at")) & (F.col("_upto") - F.col("_c") <= F.ceil("w._at")))
    part = F.col("w._at") - F.floor("w._at")
    ends = hits.groupBy(*group, F.col("w.name").alias("name")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first(part).alias("part"))
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return ends.groupBy(*group).agg(*[F.max(F.when(F.col("name") == name, value_at)).alias(name) for name in shares]).select(*keys, *shares)
