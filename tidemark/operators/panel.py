"""Returns, volatility and the research panel.

Windows run over one sid's days, which the length of the calendar bounds. Frames are always rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.timeseries import lagged_curves


def by_day(keys: tuple[str, ...] = ("sid",), order: tuple[str, ...] = ("day",)) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def day_return(close: str, w: WindowSpec) -> Column:
    """close / previous close - 1, null for the first row and for a previous close of 0."""
    return F.try_divide(F.col(close), F.lag(close).over(w)) - 1


def rolling_std(column: str, w: WindowSpec, rows: int, least: int) -> Column:
    """Sample deviation over the last ``rows`` rows where at least ``least`` of them have a value."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= least, F.stddev_samp(column).over(frame))


def returns_and_vol(daily: DataFrame, rows: int = 20, least: int = 5, floor: float = 0.005, horizons: int = 3) -> DataFrame:
    """(sid, day, ret, vol_20d, fwd_ret_1..k): simple returns, rolling deviation filled forward within the sid and floored."""
    w = by_day()
    out = daily.select("sid", "day", "close", day_return("close", w).alias("ret"), *[(F.try_divide(F.lead("close", k).over(w), F.col("close")) - 1).alias(f"fwd_ret_{k}") for k in range(1, horizons + 1)])
    out = out.withColumn("_v", rolling_std("ret", w, rows, least))
    last = F.last("_v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("vol_20d", F.when(last.isNotNull(), F.greatest(last, F.lit(floor)))).drop("_v", "close")


def log_returns(df: DataFrame, close: str = "close", order: tuple[str, ...] = ("day",), rows: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keys, log_ret, sigma): log returns, the first 0; the deviation of the last full ``rows`` rows, filled forward."""
    w = by_day(order=order)
    out = df.select("sid", *order, *keep, F.coalesce(F.ln(close) - F.lag(F.ln(close)).over(w), F.lit(0.0)).alias("log_ret"))
    out = out.withColumn("_s", rolling_std("log_ret", w, rows, rows))
    return out.withColumn("sigma", F.last("_s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def forward_sum(column: str, w: WindowSpec, k: int) -> Column:
    """Sum over the next k rows, null where there are fewer."""
    frame = w.rowsBetween(1, k)
    return F.when(F.count(column).over(frame) == k, F.sum(column).over(frame))


def research_panel(curves: DataFrame, daily: DataFrame, cross_days: int = 2) -> DataFrame:
    """Curves with their lags joined to volatility and forward returns on (sid, day)."""
    lags = lagged_curves(curves, cross_days, ["daily_curve", "curve_len"])
    return lags.join(returns_and_vol(daily).drop("ret"), ["sid", "day"])


def snapshot_panel(daily: DataFrame, instrument: DataFrame, min_age: int = 120, least_sigma: float = 1e-4, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Second-generation panel: log returns, z = log_ret / sigma, forward sums; only rows of listed age and real volatility.

    ``daily``: sid, day (date), close. ``instrument``: sid, ipo (date).
    """
    base = log_returns(daily)
    w = by_day()
    out = base.select("*", *[forward_sum("log_ret", w, k).alias(f"fwd_{k}") for k in horizons])
    old = out.join(instrument, "sid").where(F.datediff("day", "ipo") >= min_age).where(F.col("sigma") >= least_sigma)
    return old.select("sid", "day", "log_ret", "sigma", (F.col("log_ret") / F.col("sigma")).alias("z"), *[f"fwd_{k}" for k in horizons])


def adjusted(prices: DataFrame, factors: DataFrame, columns: list[str]) -> DataFrame:
    """Forward-adjusted prices: price * factor in force on the day / last factor of the sid; 1 before the first factor.

    ``factors``: sid, day, factor; the factor of a day holds until the next one. As-of by union and one window.
    """
    w = W.partitionBy("sid").orderBy("day", "_is").rowsBetween(W.unboundedPreceding, 0)
    both = prices.withColumn("_is", F.lit(1)).withColumn("factor", F.lit(None).cast("double")).unionByName(factors.select("sid", "day", F.col("factor").cast("double").alias("factor"), F.lit(0).alias("_is")), allowMissingColumns=True)
    out = both.withColumn("_now", F.last("factor", ignorenulls=True).over(w)).withColumn("_last", F.max_by("factor", F.when(F.col("_is") == 0, F.col("day"))).over(W.partitionBy("sid")))
    ratio = F.coalesce(F.col("_now") / F.col("_last"), F.lit(1.0))
    return reduce(lambda d, c: d.withColumn(c, F.col(c) * ratio), columns, out.where("_is = 1")).drop("_is", "_now", "_last", "factor")
