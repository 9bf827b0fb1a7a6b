"""Point-in-time universes and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.globalrank import global_index


def monthly(daily: DataFrame, instrument: DataFrame) -> DataFrame:
    """Per (sid, month_id): mean amount, last trade date, days since the first trading date, and the month it holds for.

    ``daily``: sid, date, amount. ``instrument``: sid, ipo (date), at most one row per sid. A null amount doesn't
    count in the mean; an unknown ipo gives a null age.
    """
    m = lambda c: F.date_format(c, "yyyyMM").cast("int")
    joined = daily.join(instrument, "sid", "left").withColumn("month_id", m(F.col("date")))
    return joined.groupBy("sid", "month_id").agg(
        F.avg("amount").alias("avg_amount"), F.max("date").alias("last_trade_date"),
        F.datediff(F.max("date"), F.max("ipo")).alias("days_since_ipo"), m(F.add_months(F.max("date"), 1)).alias("trade_month_id"),
    )


def average_rank(order: Column, partition: list[str], value: Column) -> Column:
    """Rank by ``order`` with equal values sharing their average rank. A group must be bounded."""
    return F.rank().over(W.partitionBy(*partition).orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*partition, value)) - 1) / 2


def kept_by_rank(months: DataFrame, min_age: int = 120, share: float = 0.8) -> DataFrame:
    """Months of age >= min_age whose mean amount ranks within ``share`` of their month, equal amounts averaged.

    Equal amounts are counted first, so the ranking window runs over distinct amounts of a month and not over its rows.
    """
    old = months.where(F.col("days_since_ipo") >= min_age)
    sizes = old.groupBy("month_id").agg(F.count(F.lit(1)).alias("_n"))
    ties = old.where(F.col("avg_amount").isNotNull() & ~F.isnan("avg_amount")).groupBy("month_id", "avg_amount").agg(F.count(F.lit(1)).alias("_k"))
    upto = W.partitionBy("month_id").orderBy(F.col("avg_amount").desc()).rowsBetween(W.unboundedPreceding, 0)
    ranked = ties.withColumn("_rank", F.sum("_k").over(upto) - F.col("_k") + (F.col("_k") + 1) / 2).join(sizes, "month_id").where(F.col("_rank") <= share * F.col("_n"))
    return old.join(ranked.select("month_id", "avg_amount", F.col("_rank").alias("rank"), F.col("_n").alias("n")), ["month_id", "avg_amount"])


def universe(daily: DataFrame, instrument: DataFrame, min_age: int = 120, share: float = 0.8) -> DataFrame:
    """Daily rows of sids that were kept the month before, traded that day and moved within it."""
    kept = kept_by_rank(monthly(daily, instrument), min_age, share).select("sid", F.col("trade_month_id").alias("month_id"))
    rows = daily.withColumn("month_id", F.date_format("date", "yyyyMM").cast("int"))
    return rows.join(kept, ["sid", "month_id"], "left_semi").where("volume > 0 and high > low")


def stratified_sample(turnover: DataFrame, top: float = 0.8, layers: int = 5, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """A repeatable sample of sids by mean turnover: the top share, split into equal layers, ``rate`` of each, at least one.

    ``turnover``: sid, turnover; one row per sid, null turnovers don't count. Rows are drawn in the order of a seeded
    hash. Positions come from a distributed sort, draws from a window over one layer.
    """
    known = turnover.where("turnover is not null").select("sid", "turnover")
    ranked = global_index(known, [F.col("turnover").desc(), F.col("sid")], "_i")
    keep = int(ranked.count() * top)
    size = max(keep // layers, 1)
    ranked = ranked.where(F.col("_i") < keep)
    layered = ranked.withColumn("layer", F.least(F.floor(F.col("_i") / size), F.lit(layers - 1)).cast("int"))
    drawn = W.partitionBy("layer").orderBy(F.xxhash64("sid", F.lit(seed)), "sid")
    in_layer = F.count(F.lit(1)).over(W.partitionBy("layer"))
    return layered.withColumn("_k", F.row_number().over(drawn)).withColumn("_m", in_layer).where(F.col("_k") <= F.greatest(F.floor(F.col("_m") * rate), F.lit(1))).select("sid", "turnover", "layer")
