"""Bars, skeletons, fills, resampling and alignment of ordered rows.

Every ordered operation names a total order, so results don't depend on partitioning. Windows are partitioned by
(sid, day) or another bounded key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.exprs import EPS, money_flow
from tidemark.operators.globalrank import global_index
from tidemark.session import written


def filled(column: str, keys: list[str], order: list[str], backward: bool = True) -> Column:
    """Last value at or before the row; with ``backward``, else the next one after it. Keys must bound a group."""
    w = W.partitionBy(*keys).orderBy(*order)
    ahead = F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if not backward:
        return ahead
    falling = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(ahead, F.last(column, ignorenulls=True).over(falling))


def minute_bars(ticks: DataFrame) -> DataFrame:
    """One row per (sid, day, minute_idx) from ticks with those columns, ``at`` and OHLC, volume, amount.

    First, greatest, least and last by (at, value) of those that are there; sums of volume and amount. Exact duplicates should be gone.
    """
    first_last = [F.min(F.when(F.col("open").isNotNull(), F.struct("at", "open"))).alias("_o"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.when(F.col("close").isNotNull(), F.struct("at", "close"))).alias("_c")]
    return (
        ticks.groupBy("sid", "day", "minute_idx").agg(*first_last, F.sum("volume").alias("volume"), F.sum("amount").alias("amount"))
        .select("sid", "day", "minute_idx", F.col("_o.open").alias("open"), "high", "low", F.col("_c.close").alias("close"), "volume", "amount")
    )


def daily_bars(trades: DataFrame, order: list[str]) -> DataFrame:
    """(sid, day, open, high, low, close, volume, amount) from trades (sid, day, price, volume).

    The first and last price are by ``order`` and then the price, so rows that tie in ``order`` don't make the result depend
    on partitioning; rows without a price don't count for prices, nor for the amount. Combined before the shuffle.
    """
    first_last = F.when(F.col("price").isNotNull(), F.struct(*order, "price"))
    bars = trades.groupBy("sid", "day").agg(
        F.min(first_last).alias("_o"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(first_last).alias("_c"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("amount")
    )
    return bars.select("sid", "day", F.col("_o.price").alias("open"), "high", "low", F.col("_c.price").alias("close"), "volume", "amount")


def minute_skeleton(bars: DataFrame, minutes: int = 240) -> DataFrame:
    """Every minute of each (sid, day) that has a bar; one bar per minute. close is filled forward, then backward, within the day; open,
    high and low of an empty minute are its close; volume and amount 0. Minutes outside the session are dropped."""
    # Each bar fills the minutes up to the next one, the first also those before it: no join and no window over the grid.
    inside = bars.where(F.col("minute_idx").between(0, minutes - 1))
    day = W.partitionBy("sid", "day").orderBy("minute_idx")
    whole = day.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    held = F.coalesce(F.last("close", True).over(day.rowsBetween(W.unboundedPreceding, 0)), F.first("close", True).over(whole))
    spans = inside.select(
        "sid", "day", F.col("minute_idx").alias("_at"), "open", "high", "low", held.alias("close"), "volume", "amount", F.lead("minute_idx").over(day).alias("_to"), (F.row_number().over(day) == 1).alias("_first")
    )
    minute = F.explode(F.sequence(F.when(F.col("_first"), F.lit(0)).otherwise(F.col("_at")), F.coalesce(F.col("_to") - 1, F.lit(minutes - 1))))
    seen = F.col("_at") == F.col("minute_idx")
    return spans.select("*", minute.alias("minute_idx")).select(
        "sid", "day", "minute_idx", *[F.coalesce(F.when(seen, F.col(c)), "close").alias(c) for c in ("open", "high", "low")], "close",
        *[F.coalesce(F.when(seen, F.col(c)), F.lit(0.0)).alias(c) for c in ("volume", "amount")],
    )


def flow_ratio_bars(skeleton: DataFrame, downsample: int = 5) -> DataFrame:
    """Money flow over bars of ``downsample`` minutes: (sid, day, bar_idx, agg_ofi, agg_amount, close, ofi_ratio);
    the ratio runs from the day's first bar on."""
    flow = money_flow(F.col("close"), F.col("high"), F.col("low"), F.col("amount"))
    bars = skeleton.groupBy("sid", "day", F.floor(F.col("minute_idx") / downsample).cast("int").alias("bar_idx")).agg(
        F.sum(flow).alias("agg_ofi"), F.sum("amount").alias("agg_amount"), F.max_by("close", "minute_idx").alias("close")
    )
    running = W.partitionBy("sid", "day").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    return bars.withColumn("ofi_ratio", F.sum("agg_ofi").over(running) / (F.sum("agg_amount").over(running) + EPS))


def daily_curves(bars: DataFrame, value: str = "ofi_ratio", length: int | None = None) -> DataFrame:
    """(sid, day, daily_curve, curve_len): the day's values in bar order; with ``length`` only days of that many non-null points."""
    out = bars.groupBy("sid", "day").agg(F.sort_array(F.collect_list(F.struct("bar_idx", value))).alias("_p"), F.count(value).alias("curve_len"))
    out = out.select("sid", "day", F.transform("_p", lambda p: p[value]).alias("daily_curve"), "curve_len")
    return out if length is None else out.where(F.col("curve_len") == length)


def lagged_curves(curves: DataFrame, cross_days: int, keep: list[str] = ()) -> DataFrame:
    """lag_0 .. lag_{n-1}: curves of the sid's last n rows by day; only rows that have them all."""
    w = W.partitionBy("sid").orderBy("day")
    out = curves.select("sid", "day", *keep, F.col("daily_curve").alias("lag_0"), *[F.lag("daily_curve", i).over(w).alias(f"lag_{i}") for i in range(1, cross_days)])
    return out.dropna(subset=[f"lag_{i}" for i in range(cross_days)])


def joined_lags(cross_days: int) -> Column:
    """The lags as one curve, oldest first."""
    return F.concat(*[F.col(f"lag_{i}") for i in range(cross_days - 1, -1, -1)])


def resampled(df: DataFrame, keys: list[str], ts: str, every: str, aggs: dict[str, str], right: bool = False) -> DataFrame:
    """Tumbling windows of a fixed length: left-closed and labelled by their start, or right-closed by their end.

    ``aggs`` maps a column to first, last, max, min, mean or sum. Order within a window is by ``ts``, then the value.
    Works on streams as well when first and last aren't asked for.
    """
    at = F.col(ts) - F.expr("interval 1 microsecond") if right else F.col(ts)
    how = {
        "first": lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(c))))[c], "last": lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(c))))[c],
        "max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum,
    }
    w = F.window(at, every)
    out = df.groupBy(*keys, w.alias("_w")).agg(*[how[h](c).alias(c) for c, h in aggs.items()])
    return out.select(*keys, F.col("_w.end" if right else "_w.start").alias(ts), *aggs)


def asof_index(data: DataFrame, clock: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    """Each data row with ``clock_ts``, the first clock time at or after it; null beyond the clock's end, and for a null time.

    ``clock`` holds ``ts`` and the keys. Both are put together and range-partitioned by (keys, time); a range looks within
    itself, and where its clock has run out takes the first time of the ranges after it, one row each. So no task holds a
    key or a stretch of time, however much lies there.
    """
    columns, kind, by = data.columns, dict(data.dtypes)[ts], list(keys)
    both = data.withColumn("_clock", F.lit(None).cast(kind)).withColumn("_is", F.lit(0)).unionByName(
        clock.select(*by, ts).where(F.col(ts).isNotNull()).distinct().withColumn("_clock", F.col(ts)).withColumn("_is", F.lit(1)), allowMissingColumns=True
    )
    ranged = written(both.repartitionByRange(*by, ts).withColumn("_range", F.spark_partition_id()), "asof-ranges")
    group = [*by, "_range"]
    firsts = ranged.groupBy(*group).agg(F.min("_clock").alias("_first"))
    later = firsts.select(*group, F.min("_first").over(W.partitionBy(*by).orderBy("_range").rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    # From late to early: a clock row comes before data rows of its own time.
    w = W.partitionBy(*group).orderBy(F.col(ts).desc(), F.col("_is").desc()).rowsBetween(W.unboundedPreceding, 0)
    within = ranged.withColumn("_here", F.last("_clock", ignorenulls=True).over(w)).where("_is = 0")
    same = [within[g].eqNullSafe(later[g]) for g in group]
    out = within.join(later, same).select(*[within[c] for c in columns], F.when(within[ts].isNotNull(), F.coalesce(within["_here"], later["_next"])).alias("clock_ts"))
    return out


def outer_merge(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of several tables on their common keys; other columns must differ."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def shifted(df: DataFrame, keys: list[str], order: list[str], columns: list[str], n: int = 1) -> DataFrame:
    """Columns shifted by n rows within their key; rows with nothing left are dropped, other nulls become 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.select(*keys, *order, *[(F.lag(c, n) if n >= 0 else F.lead(c, -n)).over(w).alias(c) for c in columns])
    return out.dropna(how="all", subset=columns).fillna(0, subset=columns)


def wide_metrics(log: DataFrame, keys: list[str], name: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """Long metrics to one column each: the last value per key, then filled forward along the keys' last column."""
    wide = log.where(F.col(value).isNotNull()).groupBy(*keys).pivot(name, names).agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(value).alias("v"))))
    wide = wide.select(*keys, *[F.col(f"`{n}`.v").alias(n) for n in names])
    w = W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, 0)
    return wide.select(*keys, *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])


def positional_concat(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Columns of two tables side by side by position in their orders; the shorter one ends in nulls. Names must differ."""
    left, right = global_index(a, [F.col(c) for c in order_a], "_i"), global_index(b, [F.col(c) for c in order_b], "_i")
    return left.join(right, "_i", "full_outer").drop("_i")
