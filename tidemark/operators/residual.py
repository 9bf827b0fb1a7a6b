"""Snapshots and residual curves of intraday bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.exprs import array_mean
from tidemark.session import written


def snapshot(bars: DataFrame, at: str, minute_of_day: str, cutoff: int = 895) -> DataFrame:
    """The last row of each (sid, day) at or before a minute of the day (14:55 is 895), all columns.

    Ties on ``at`` go to the greatest row."""
    rest = [c for c in bars.columns if c not in ("sid", "day", at)]
    return bars.where(F.col(minute_of_day) <= cutoff).groupBy("sid", "day").agg(F.max(F.struct(at, *rest)).alias("r")).select("sid", "day", "r.*")


def residuals(bars: DataFrame, signal: str = "close", reset_daily: bool = False) -> DataFrame:
    """(sid, day, minute_idx, residual, cum): log returns less the median of their minute over all sids, summed up.

    ``signal``: close; vwap, amount / volume with close where volume is 0; vpt, close weighted by volume over the
    (sid, day) mean. A sid's first return is 0. The median of a minute is an aggregate joined back, not a window over
    all sids of that minute. Windows run within one (sid, day); only each day's last price and total run along a sid,
    so a sid with most of the rows is many tasks' work.
    """
    price = F.col("close")
    if signal == "vwap":
        price = F.when(F.col("volume") > 0, F.try_divide("amount", "volume")).otherwise(price)
    day = W.partitionBy("sid", "day").orderBy("minute_idx")
    days = W.partitionBy("sid").orderBy("day")
    weight = F.lit(1.0)
    if signal == "vpt":
        mean = F.avg("volume").over(W.partitionBy("sid", "day"))
        weight = F.when(mean > 0, F.col("volume") / mean).otherwise(F.lit(1.0))
    # All that needs the order within a day is done in one pass over it; the day's first return waits for the day before.
    rows = bars.select("sid", "day", "minute_idx", "volume", F.ln(F.when(price > 0, price)).alias("_l"))
    rows = written(rows.select("sid", "day", "minute_idx", "_l", (F.col("_l") - F.lag("_l").over(day)).alias("_r"), (F.row_number().over(day) == 1).alias("_first"), weight.alias("_w")), "returns")
    last = rows.groupBy("sid", "day").agg(F.max_by("_l", "minute_idx").alias("_last")).select("sid", "day", F.lag("_last").over(days).alias("_before"))
    ret = F.coalesce(F.when(F.col("_first"), F.col("_l") - F.col("_before")).otherwise(F.col("_r")), F.lit(0.0))
    returns = rows.join(last, ["sid", "day"]).select("sid", "day", "minute_idx", ret.alias("ret"), "_w")
    medians = returns.groupBy("day", "minute_idx").agg(F.expr("percentile(ret, 0.5)").alias("_m"))
    out = returns.join(medians, ["day", "minute_idx"]).select("sid", "day", "minute_idx", ((F.col("ret") - F.col("_m")) * F.col("_w")).alias("residual"))
    if reset_daily:
        return out.withColumn("cum", F.sum("residual").over(day.rowsBetween(W.unboundedPreceding, 0)))
    out = written(out, "residuals")
    offsets = out.groupBy("sid", "day").agg(F.sum("residual").alias("_s")).select("sid", "day", F.coalesce(F.sum("_s").over(days.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_offset"))
    return out.join(offsets, ["sid", "day"]).select("sid", "day", "minute_idx", "residual", (F.sum("residual").over(day.rowsBetween(W.unboundedPreceding, 0)) + F.col("_offset")).alias("cum"))


def eod_features(cum: DataFrame, prices: DataFrame, downsample: int = 5, m: int = 12, amplify: float = 1000.0, cutoff: int = 235, stale: int = 225, flat: float = 1e-5) -> DataFrame:
    """(sid, day, curve): the m last values, in right-closed buckets of ``downsample`` minutes, up to each day's last bucket.

    Minutes are session minutes; 14:55 is 235. A day is left out if its last bucket's newest minute is before
    ``stale`` (14:45), or the population deviation of its last three prices is below ``flat``, or history is short.
    """
    rows = cum.join(prices.select("sid", "day", "minute_idx", "close"), ["sid", "day", "minute_idx"]).where(F.col("minute_idx") <= cutoff)
    bucket = F.ceil((F.col("minute_idx") + F.lit(0)) / downsample).cast("int")
    last = F.max(F.struct("minute_idx", "cum", "close")).alias("r")
    b = rows.groupBy("sid", "day", bucket.alias("bucket")).agg(last).select("sid", "day", "bucket", F.col("r.minute_idx").alias("newest"), (F.col("r.cum") * amplify).alias("v"), F.col("r.close").alias("close"))
    # One row per day with its buckets in order, so that windows along a sid run over days and not over buckets.
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "newest", "v", "close")))
    days = b.groupBy("sid", "day").agg(ordered.alias("b")).select("sid", "day", F.transform("b", lambda x: x["v"]).alias("v"), F.transform("b", lambda x: x["close"]).alias("p"), F.element_at("b", -1)["newest"].alias("newest"))
    along = W.partitionBy("sid").orderBy("day")

    def trailing(name: str, n: int) -> Column:
        joined = F.flatten(F.collect_list(F.slice(F.col(name), F.greatest(F.size(name) - (n - 1), F.lit(1)), F.lit(n))).over(along.rowsBetween(-(n - 1), 0)))
        return F.slice(joined, F.greatest(F.size(joined) - (n - 1), F.lit(1)), F.lit(n))

    ends = days.select("sid", "day", "newest", trailing("v", m).alias("curve"), trailing("p", 3).alias("_p"))
    mean = array_mean(F.col("_p"))
    ends = ends.withColumn("_m", mean).withColumn("_sd", F.sqrt(F.aggregate("_p", F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / F.size("_p")))
    return ends.where((F.size("curve") == m) & (F.col("newest") >= stale) & (F.col("_sd") >= flat)).select("sid", "day", "curve")
