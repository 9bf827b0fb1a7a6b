"""Totals and averages over trailing calendar periods, for every entity and day, days without rows included.

The table is first reduced to one row per (entity, day). Each total goes to the bucket of its day and to the next
one; each calendar date looks only into its own bucket, which therefore holds all that its longest period can
reach. The range join meets on (entity, bucket), so a hot entity spreads over its buckets, and the aggregate by
(entity, bucket, date) needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def daily_totals(df: DataFrame, entity: str, day: Column, measures: dict[str, Column]) -> DataFrame:
    """One row (entity, day, <m>_sum, <m>_n) per entity and day; nulls and NaN don't count, a day of nulls has n 0."""
    clean = {k: F.when(~F.isnan(v.cast("double")), v.cast("double")) for k, v in measures.items()}
    rows = df.select(F.col(entity).alias("entity"), day.cast("int").alias("day"), *[v.alias(k) for k, v in clean.items()])
    aggs = [a for k in measures for a in (F.coalesce(F.sum(k), F.lit(0.0)).alias(f"{k}_sum"), F.count(k).alias(f"{k}_n"))]
    return rows.where("entity is not null and day is not null").groupBy("entity", "day").agg(*aggs)


def trailing(totals: DataFrame, measures: list[str], periods: tuple[int, ...] = (7, 30), warm_up: int | None = None) -> DataFrame:
    """For each entity and calendar day from ``warm_up`` days after its first row to its last row: <m>_total_<p>,
    <m>_n_<p> and <m>_avg_<p> over that day and the p - 1 days before it.

    ``totals`` is what daily_totals gives. ``day`` counts days since the epoch. ``warm_up`` defaults to the longest
    period less one, so that every period is complete; 0 gives all days. A total over no readings is 0, an average
    null. An entity with a shorter history than warm_up gives no rows, as does an empty table.
    """
    longest = max(periods)
    warm_up = longest - 1 if warm_up is None else warm_up
    totals = written(totals, "daily-totals")
    bucket = lambda c: F.floor(c / longest).cast("int")
    reach = totals.select("*", F.explode(F.array(bucket(F.col("day")), bucket(F.col("day")) + 1)).alias("bucket"))
    span = totals.groupBy("entity").agg((F.min("day") + warm_up).alias("lo"), F.max("day").alias("hi")).where("lo <= hi")
    calendar = span.select("entity", "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("bucket"))
    dates = calendar.repartition("entity", "bucket").select(
        "entity", "bucket",
        F.explode(F.sequence(F.greatest(F.col("lo"), F.col("bucket") * longest), F.least(F.col("hi"), F.col("bucket") * longest + (longest - 1)))).alias("date"),
    )
    joined = dates.alias("c").join(
        reach.alias("t"),
        (F.col("c.entity") == F.col("t.entity")) & (F.col("c.bucket") == F.col("t.bucket")) & (F.col("t.day") <= F.col("c.date")) & (F.col("t.day") > F.col("c.date") - longest),
        "left",
    )
    aggs = []
    for m in measures:
        for p in periods:
            inside = F.col("t.day") > F.col("c.date") - p
            aggs += [F.coalesce(F.sum(F.when(inside, F.col(f"t.{m}_sum"))), F.lit(0.0)).alias(f"{m}_total_{p}"), F.coalesce(F.sum(F.when(inside, F.col(f"t.{m}_n"))), F.lit(0)).alias(f"{m}_n_{p}")]
    out = joined.groupBy(F.col("c.entity").alias("entity"), F.col("c.bucket").alias("bucket"), F.col("c.date").alias("day")).agg(*aggs).drop("bucket")
    return out.select("*", *[F.try_divide(F.col(f"{m}_total_{p}"), F.col(f"{m}_n_{p}")).alias(f"{m}_avg_{p}") for m in measures for p in periods])
