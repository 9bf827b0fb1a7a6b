"""Tail bins from generalised Pareto fits, once or on a rolling calendar, over all returns of a key.

No key's returns are gathered: quantiles come from a sketch with a rank error of 1e-5, means from sums, and the profile
likelihood of the tails is evaluated as sums of logarithms at a grid of parameters, twice: over the whole range, then
between the neighbours of the best. Sums combine before they are shuffled, so a hot key is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.salting import spread_join
from tidemark.session import written

QUANTILES = (0.05, 0.25, 0.75, 0.95)
GRID = 60


def _grid(lo: Column, hi: Column, n: int) -> Column:
    """n + 1 points from lo to hi, evenly."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: lo + (hi - lo) * i / n)


def _best(excess: DataFrame, grids: DataFrame) -> DataFrame:
    """(key, side, theta, below, above, xi, sigma): the parameter of the grid with the greatest likelihood.

    Per exceedance x and parameter t the likelihood needs the mean of ln(1 - t x); infeasible parameters drop out.
    """
    rows = spread_join(excess, grids, ["key", "side"]).select("key", "side", "x", F.posexplode("grid").alias("i", "theta"))
    inside = 1 - F.col("theta") * F.col("x")
    sums = rows.groupBy("key", "side", "i", "theta").agg(F.avg(F.when(inside > 0, F.ln(inside))).alias("xi"), F.min(inside).alias("_least"), F.avg("x").alias("mean"))
    flat = F.abs(F.col("theta")) * F.col("mean") < 1e-9
    sigma = F.when(flat, F.col("mean")).otherwise(F.try_divide(-F.col("xi"), F.col("theta")))
    scored = sums.withColumn("sigma", sigma).withColumn("xi", F.when(flat, 0.0).otherwise(F.col("xi"))).where("_least > 0 and sigma > 0").withColumn("loss", F.ln("sigma") + F.col("xi") + 1)
    best = scored.groupBy("key", "side").agg(F.min(F.struct("loss", "i", "theta", "xi", "sigma")).alias("b")).select("key", "side", "b.*")
    around = best.join(grids, ["key", "side"])
    n = F.size("grid")
    return around.select("key", "side", "theta", F.get("grid", F.greatest(F.col("i") - 1, F.lit(0))).alias("below"), F.get("grid", F.least(F.col("i") + 1, n - 1)).alias("above"), "xi", "sigma")


def gpd_bins(returns: DataFrame, value: str, key: str | None = None, quantiles: tuple[float, ...] = QUANTILES, least: int = 50, tail: int = 10) -> DataFrame:
    """(key, edges, centres) per key, or one row without a key; keys with fewer than ``least`` finite returns are left out.

    Edges are quantiles. Inner centres are the mean of their bin, or its midpoint when empty. A tail's centre is
    u -+ sigma / (1 - xi) with more than ``tail`` exceedances and xi < 1, else the tail's mean, else the edge. Null, NaN
    and infinite returns and null keys don't count; an empty table gives no rows.
    """
    k = F.col(key) if key else F.lit("all")
    x = F.col(value).cast("double")
    known = written(returns.select(k.alias("key"), x.alias("x")).where("key is not null and x is not null and not isnan(x) and abs(x) < double('inf')"), "returns")
    edges = written(known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*[F.lit(q) for q in quantiles]), F.lit(100_000)).alias("edges")).where(F.col("n") >= least), "edges")
    last = len(quantiles) - 1
    binned = spread_join(known, edges.select("key", "edges"), ["key"]).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    means = binned.groupBy("key", "bin").agg(F.avg("x").alias("mean"))

    lower, upper = F.get("edges", F.lit(0)), F.get("edges", F.lit(last))
    excess = binned.where((F.col("bin") == 0) | (F.col("bin") == last + 1)).select("key", F.when(F.col("bin") == 0, -1).otherwise(1).alias("side"), F.when(F.col("bin") == 0, lower - F.col("x")).otherwise(F.col("x") - upper).alias("x")).where("x > 0")
    sizes = excess.groupBy("key", "side").agg(F.count(F.lit(1)).alias("m"), F.avg("x").alias("mean"), F.max("x").alias("top")).where(F.col("m") > tail)
    # From heavy tails (theta far below 0) over the exponential (0) to a finite end (1 / top).
    log_part = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: -F.exp(F.ln(20 / F.col("mean")) + F.ln(F.lit(1e-5 / 20)) * i / GRID))
    whole = F.concat(log_part, F.array(F.lit(0.0)), _grid(1e-6 / F.col("top"), (1 - 1e-6) / F.col("top"), GRID))
    coarse = written(_best(excess, sizes.select("key", "side", whole.alias("grid"))), "tail-fit")
    fine = _best(excess, coarse.select("key", "side", _grid(F.col("below"), F.col("above"), GRID).alias("grid")))
    ends = fine.where("xi < 1").select("key", F.when(F.col("side") < 0, 0).otherwise(last + 1).alias("bin"), (F.col("side") * F.col("sigma") / (1 - F.col("xi"))).alias("beyond"))

    grid = edges.select("key", "edges", F.explode(F.sequence(F.lit(0), F.lit(last + 1))).alias("bin"))
    cells = grid.join(means, ["key", "bin"], "left").join(ends, ["key", "bin"], "left")
    before, after = F.get("edges", F.col("bin") - 1), F.get("edges", F.col("bin"))
    edge = F.when(F.col("bin") == 0, lower).otherwise(upper)
    outer = (F.col("bin") == 0) | (F.col("bin") == last + 1)
    centre = F.when(outer, F.coalesce(edge + F.col("beyond"), "mean", edge)).otherwise(F.coalesce("mean", (before + after) / 2))
    out = cells.groupBy("key", "edges").agg(F.sort_array(F.collect_list(F.struct("bin", centre.alias("c")))).alias("_c")).select("key", "edges", F.transform("_c", lambda c: c["c"]).alias("centres"))
    return out.withColumnRenamed("key", key) if key else out.drop("key")


def rolling_gpd(returns: DataFrame, day: str, value: str, days: int = 60, every_months: int = 3, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(day, edges, centres): parameters fitted on each refit day to all returns of its last ``days`` days, in force
    until the next one.

    ``day`` is a date. A refit day is the first with a return of every ``every_months``-th calendar month. Days before
    the first fit have nulls. Calendar windows run over one row per day.
    """
    known = returns.select(F.col(day).alias("day"), F.col(value).cast("double").alias("x")).where("day is not null and x is not null and not isnan(x)")
    calendar = known.select("day").distinct()
    period = F.floor((F.year("day") * 12 + F.month("day")) / every_months)
    calendar = written(calendar.withColumn("_p", period).withColumn("i", F.row_number().over(W.orderBy("day"))).withColumn("refit", F.row_number().over(W.partitionBy("_p").orderBy("day")) == 1).drop("_p"), "calendar")
    fits = calendar.where("refit").select(F.col("day").alias("fit_day"), F.explode(F.sequence(F.greatest(F.col("i") - (days - 1), F.lit(1)), F.col("i"))).alias("i"))
    of_day = fits.join(calendar.select("day", "i"), "i").groupBy("day").agg(F.collect_list("fit_day").alias("fit_days"))
    pools = spread_join(known, of_day, ["day"]).select(F.explode("fit_days").alias("fit_day"), "x")
    fitted = gpd_bins(pools, "x", "fit_day", quantiles).withColumnRenamed("fit_day", "day")
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return calendar.select("day").join(fitted, "day", "left").select("day", F.last("edges", True).over(upto).alias("edges"), F.last("centres", True).over(upto).alias("centres"))
