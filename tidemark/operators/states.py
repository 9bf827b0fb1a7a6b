"""Macro states, return bins, Markov chains and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.exprs import array_sum, nearest_quantile
from tidemark.operators.panel import by_day, day_return

# Weights of the return bins and of the horizons.
WEIGHTS = (-1.0, -0.5, 0.5, 1.0)
HORIZON_WEIGHTS = (0.5, 0.3, 0.2)


def daily_flow(curves: DataFrame) -> DataFrame:
    """Mean over sids of the sum of each day's curve; curves holding a NaN count without their NaN points."""
    clean = F.filter("daily_curve", lambda x: x.isNotNull() & ~F.isnan(x))
    return curves.groupBy("day").agg(F.avg(array_sum(clean)).alias("flow"))


def tercile_bounds(values: DataFrame, column: str) -> tuple[float | None, float | None]:
    """Nearest-rank terciles; ``values`` has one row per day, so its sorted list is small."""
    row = values.agg(F.sort_array(F.collect_list(column)).alias("v")).select(nearest_quantile(F.col("v"), 1 / 3).alias("lo"), nearest_quantile(F.col("v"), 2 / 3).alias("hi")).first()
    return row["lo"], row["hi"]


def macro_terciles(curves: DataFrame, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(day, flow, macro_state): 0 up to the lower tercile, 1 up to the upper one, else 2. ``bounds`` come from training."""
    flow = daily_flow(curves)
    lo, hi = bounds or tercile_bounds(flow, "flow")
    state = F.when(F.col("flow") <= F.lit(lo), 0).when(F.col("flow") <= F.lit(hi), 1).when(F.col("flow").isNotNull(), 2)
    return flow.withColumn("macro_state", state)


def rolling_macro(bench: DataFrame, rows: int = 60, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """(day, ret, macro_state) of one benchmark series: 0 below its rolling lower quantile, 2 above the upper, else 1.

    Quantiles are linear, over the last ``rows`` returns including the row's own, null with fewer than half of them.
    ``bench``: sid, day, close.
    """
    w = by_day()
    frame = w.rowsBetween(-(rows - 1), 0)
    out = bench.select("sid", "day", F.coalesce(day_return("close", w), F.lit(0.0)).alias("ret"))
    enough = F.count("ret").over(frame) >= rows // 2
    out = out.select("*", *[F.when(enough, F.expr(f"percentile(ret, {q}) over (partition by sid order by day rows between {rows - 1} preceding and current row)")).alias(n) for n, q in (("_lo", low), ("_hi", high))])
    return out.where("_lo is not null").select("sid", "day", "ret", F.when(F.col("ret") < F.col("_lo"), 0).when(F.col("ret") > F.col("_hi"), 2).otherwise(1).alias("macro_state"))


def return_bin(ret: Column, vol: Column, k: int, bound: float) -> Column:
    """0..3 by ret / (vol * sqrt(k)) against -bound, 0, bound; null for a null or NaN operand or no volatility."""
    z = F.try_divide(ret, vol * math.sqrt(k))
    ok = ret.isNotNull() & vol.isNotNull() & ~F.isnan(ret) & ~F.isnan(vol)
    return F.when(ok, F.when(z < -bound, 0).when(z < 0, 1).when(z < bound, 2).when(z.isNotNull(), 3))


def rank_bins(df: DataFrame, partition: str, value: str, bins: int, tie: str) -> DataFrame:
    """Equal-frequency bins within a partition by ordinal rank: floor((rank - 1) / n * bins); nulls don't rank."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    rank = F.row_number().over(W.partitionBy(partition).orderBy(value, tie))
    n = F.count(F.lit(1)).over(W.partitionBy(partition))
    return known.withColumn("bin", F.least(F.floor((rank - 1) / n * bins), F.lit(bins - 1)).cast("int"))


def transitions(rows: DataFrame, chain: list[tuple[str, int]]) -> DataFrame:
    """(step, from_state, to_state, n, p) along ``chain`` of (column, states), with one prior count per cell.

    Only rows with all labels count. The full grid of states is built from the chain, so empty cells are there.
    """
    labels = rows.dropna(subset=[c for c, _ in chain])
    counts = labels.groupBy(*[c for c, _ in chain]).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for (a, na), (b, nb) in zip(chain, chain[1:], strict=False):
        grid = rows.sparkSession.range(na * nb).select(F.floor(F.col("id") / nb).cast("int").alias("from_state"), (F.col("id") % nb).cast("int").alias("to_state"))
        cells = counts.groupBy(F.col(a).cast("int").alias("from_state"), F.col(b).cast("int").alias("to_state")).agg(F.sum("n").alias("n"))
        step = grid.join(cells, ["from_state", "to_state"], "left").select(F.lit(f"{a}->{b}").alias("step"), "from_state", "to_state", F.coalesce("n", F.lit(0)).alias("n"))
        out = step if out is None else out.unionByName(step)
    total = F.sum("n").over(W.partitionBy("step", "from_state"))
    size = F.count(F.lit(1)).over(W.partitionBy("step", "from_state"))
    return out.withColumn("p", (F.col("n") + 1) / (total + size))


def state_scores(chain: DataFrame, columns: list[str]) -> DataFrame:
    """(macro_state, fsm_score): expected weights of the horizons' distributions, walked along the chain by joins."""
    steps = [f"{a}->{b}" for a, b in zip(columns, columns[1:], strict=False)]
    dist = chain.where(F.col("step") == steps[0]).select(F.col("from_state").alias("macro_state"), F.col("to_state").alias("bin"), "p")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("bin") + 1)
    out = None
    for i, h in enumerate(HORIZON_WEIGHTS):
        part = dist.select("macro_state", (F.col("p") * weight * h).alias("s"))
        out = part if out is None else out.unionByName(part)
        if i + 1 < len(steps):
            nxt = chain.where(F.col("step") == steps[i + 1]).select(F.col("from_state").alias("bin"), F.col("to_state").alias("_to"), F.col("p").alias("_p"))
            dist = dist.join(nxt, "bin").groupBy("macro_state", F.col("_to").alias("bin")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))
    return out.groupBy("macro_state").agg(F.sum("s").alias("fsm_score"))


def posterior(rows: DataFrame, state: str, bin_: str, states: int, bins: int) -> DataFrame:
    """Dirichlet counts of (state, bin): one prior count each plus what was seen, and their share per state."""
    return transitions(rows.select(state, bin_), [(state, states), (bin_, bins)])


def expected_return(counts: DataFrame, centres: list[float]) -> DataFrame:
    """Expected return per state: posterior shares times the bins' centres."""
    centre = F.element_at(F.array(*[F.lit(float(c)) for c in centres]), F.col("to_state") + 1)
    return counts.groupBy(F.col("from_state").alias("state")).agg(F.sum(F.col("p") * centre).alias("expected_ret"))
