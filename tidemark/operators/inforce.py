"""The row in force of a key: its latest version by arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(df: DataFrame, keys: list[str], arrival: str, columns: list[str]) -> DataFrame:
    """One row per key with ``columns`` as of the latest ``arrival``.

    Exact duplicates collapse. Versions sharing the latest arrival are taken to be identical, as the feed
    promises. A null arrival counts as the earliest. Rows with a null key name no reading and are dropped. An
    empty table gives an empty result. ``max_by`` keeps hash aggregation with a map-side combine, so a hot key is
    reduced before the shuffle.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    arrived = F.coalesce(F.col(arrival), F.lit("0001-01-01").cast("timestamp"))
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), arrived).alias(c) for c in columns])


def yyyymmdd_position(day: Column) -> Column:
    """A number that rises with a YYYYMMDD integer and moves by about one a day; any integer is accepted."""
    y, m, d = F.floor(day / 10000), F.floor(day / 100) % 100, day % 100
    return (y * 372 + m * 31 + d).cast("long")


def yyyymmdd_date(day: Column) -> Column:
    """The date of a YYYYMMDD integer, null where there is no such date."""
    return F.to_date(F.try_to_timestamp(F.lpad(day.cast("string"), 8, "0"), F.lit("yyyyMMdd")))


def date_yyyymmdd(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")
