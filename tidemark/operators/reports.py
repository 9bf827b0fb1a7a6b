"""Data behind charts and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import page_of, volume_label
from tidemark.operators.globalrank import global_index

def dashboard(log: DataFrame, sid: str, bar_kind: str, fill_kind: str) -> DataFrame:
    """Bars of a sid with what was bought and sold at each time, in time order.

    ``log`` holds rows of several kinds, told apart by ``table_type``: bars with their own columns, and fills with direction
    and size. One scan is filtered by sid, which reaches the files; fills shrink to a row per time before they meet the
    bars. Times without fills have 0. Null sizes don't count; a fill of another direction counts on neither side.
    """
    own = log.where(F.col("sid") == F.lit(sid))
    of = lambda side: F.coalesce(F.sum(F.when(F.col("direction") == side, F.col("size"))), F.lit(0.0))
    flows = own.where(F.col("table_type") == fill_kind).groupBy("datetime").agg(of("BUY").alias("buy"), of("SELL").alias("sell"))
    bars = own.where(F.col("table_type") == bar_kind).drop("direction", "size")
    return bars.join(flows, "datetime", "left").fillna(0.0, ["buy", "sell"]).orderBy("datetime")


def candle_shapes(bars: DataFrame) -> DataFrame:
    """Body, wick and direction of each bar; up is close >= open, ``rises`` is open < close, which differ on ties."""
    return bars.select(
        "*", F.greatest("open", "close").alias("body_top"), F.least("open", "close").alias("body_bottom"), (F.col("high") - F.greatest("open", "close")).alias("upper_wick"),
        (F.least("open", "close") - F.col("low")).alias("lower_wick"), (F.col("close") >= F.col("open")).alias("up"), (F.col("open") < F.col("close")).alias("rises"),
    )


def volume_overlay(bars: DataFrame, keys: list[str], share: float = 0.15) -> DataFrame:
    """Volume scaled into the lowest ``share`` of each key's price range, and its axis label."""
    span = bars.groupBy(*keys).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.max("volume").alias("_v"))
    out = bars.join(span, keys)
    scaled = F.col("_lo") + F.coalesce(F.try_divide("volume", "_v"), F.lit(0.0)) * (F.col("_hi") - F.col("_lo")) * share
    return out.withColumn("volume_y", scaled).withColumn("volume_label", volume_label(F.col("volume"), F.col("_v"))).drop("_lo", "_hi", "_v")


def column_roles(columns: list[str], feed: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> dict[str, list[str]]:
    """Columns of a wide frame by role: feed, indicators (``ind_`` in front) and the rest, each in order."""
    return {
        "feed": [c for c in feed if c in columns], "indicator": [c for c in columns if c.startswith("ind_")],
        "analyzer": [c for c in columns if c not in feed and not c.startswith("ind_") and c != "datetime"],
    }


def paged(df: DataFrame, order: list[str], pages: int) -> DataFrame:
    """Rows with their 0-based index and page: equal contiguous ranges, the remainder on the last page."""
    rows = global_index(df, [F.col(c) for c in order], "index")
    n = rows.count()
    return rows.withColumn("page", page_of(F.col("index"), F.lit(n), pages))


def aligned_indicator(index: DataFrame, indicator: DataFrame, on: str, value: str) -> DataFrame:
    """A short series over a longer axis: nothing there or NaN is 0."""
    v = F.when(~F.isnan(value), F.col(value))
    return index.join(indicator.select(on, v.alias(value)), on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def fill_masks(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("above", F.col(a) > F.col(b)).withColumn("below", F.col(a) < F.col(b))


def tabbed(names: DataFrame, name: str, per_group: int = 6, colours: int = 10) -> DataFrame:
    """Group, place in group and colour of each name in name order; a few rows."""
    return global_index(names.select(name).distinct(), [F.col(name)], "index").select(
        name, F.floor(F.col("index") / per_group).cast("int").alias("tab"), (F.col("index") % per_group).cast("int").alias("place"), (F.col("index") % colours).cast("int").alias("colour")
    )


def index_labels(df: DataFrame, order: list[str], ticks: DataFrame, label: Column) -> DataFrame:
    """(tick, label) of axis positions: the label of the row at the rounded position, the first or last one beyond the ends.

    ``ticks`` has ``tick``, a number; rows are numbered from 0 in ``order``. An empty table gives null labels.
    """
    rows = global_index(df.withColumn("label", label), [F.col(c) for c in order], "_i").select("_i", "label")
    last = rows.count() - 1
    at = F.greatest(F.least(F.round("tick").cast("long"), F.lit(last)), F.lit(0))
    return ticks.select("tick").withColumn("_i", at.cast("long")).join(rows, "_i", "left").select("tick", "label")


def row_slice(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows from position ``start`` up to, not with, ``end`` in ``order``; negative positions count from the end."""
    rows = global_index(df, [F.col(c) for c in order], "_i")
    n = rows.count() if start < 0 or end < 0 else 0
    lo, hi = (x + n if x < 0 else x for x in (start, end))
    return rows.where((F.col("_i") >= max(lo, 0)) & (F.col("_i") < hi)).drop("_i")


def finest_clock(clocks: DataFrame, order: tuple[str, ...] = ("timeframe", "compression", "name")) -> DataFrame:
    """The row with the least (timeframe, compression), the first name among equals: one row, none of an empty table.
    Rows with a null in the first two don't count."""
    return clocks.dropna(subset=list(order[:2])).orderBy(*order).limit(1)
