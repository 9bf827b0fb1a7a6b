"""Two-sample rank and distribution tests: counts by distinct value in Spark, the p-value from a few sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.globalrank import running_sums
from tidemark.operators.salting import spread_join


def _counts(df: DataFrame, value: str, in_first: Column, keys: list[str]) -> DataFrame:
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    a = in_first.cast("long")
    return known.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(a).alias("a"), F.sum(1 - a).alias("b"))


def mann_whitney(df: DataFrame, value: str, in_first: Column, keys: list[str] = ()) -> DataFrame:
    """(keys, n1, n2, u, z): U of the first sample against the second, ties averaged, with continuity correction for
    the alternative that the first is greater. Null and NaN values don't count. z is null without variance.

    Equal values are one row; positions are sums over ranges of values, so no task ranks a whole sample.
    """
    t = F.col("a") + F.col("b")
    c = running_sums(_counts(df, value, in_first, list(keys)).withColumn("_t", t), list(keys), ["v"], {"_upto": "_t"})
    ranked = c.withColumn("rank", F.col("_upto") - t + (t + 1) / 2)
    s = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    variance = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    return s.select(*keys, "n1", "n2", u.alias("u"), F.try_divide(u - F.col("n1") * F.col("n2") / 2 - 0.5, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("z"))


def normal_tail(z: float | None) -> float:
    """P(Z >= z); 1 where there is no z."""
    return 1.0 if z is None or math.isnan(z) else math.erfc(z / math.sqrt(2)) / 2


def ladder(p: float, strict: bool = True) -> float:
    """Score of a p-value: 100 to .05, 10 to .10 (.15 where not strict), else 0."""
    return 100.0 if p <= 0.05 else 10.0 if p <= (0.10 if strict else 0.15) else 0.0


def ks_statistic(df: DataFrame, value: str, in_first: Column, keys: list[str] = ()) -> DataFrame:
    """(keys, n1, n2, d): the greatest distance of the two empirical distributions."""
    c = running_sums(_counts(df, value, in_first, list(keys)), list(keys), ["v"], {"_a": "a", "_b": "b"})
    sizes = c.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    both = spread_join(c.withColumn("_one", F.lit(1)), sizes.withColumn("_one", F.lit(1)), [*keys, "_one"])
    d = F.abs(F.try_divide("_a", "n1") - F.try_divide("_b", "n2"))
    return both.withColumn("d", d).groupBy(*keys, "n1", "n2").agg(F.max("d").alias("d"))


def ks_p(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sided p of the statistic (Kolmogorov's series)."""
    t = d * math.sqrt(n1 * n2 / (n1 + n2))
    if t < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))
