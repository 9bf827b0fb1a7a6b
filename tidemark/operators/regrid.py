"""Irregular readings onto a regular grid of slots, one grid per (source, day).

Readings are reduced to at most one row per slot, so a day holds a bounded number of values whatever its traffic.
A harmonic seasonal regression with a linear trend is fitted to each source: the normal equations are sums, built
per task and then added up per source, so a hot source is reduced in parallel and only its 27 sums meet. Missing
slots take the prediction plus the residual, drawn as a straight line between the nearest readings of the day on
either side, or held where there is one side only. Readings themselves are left as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written


@dataclass(frozen=True)
class GridConfig:
    """slots: length of a day's grid; harmonics: sine and cosine pairs over the day; ridge: weight, in readings, that
    pulls all terms but the level to zero; day_scale: days per unit of the trend; days_a_task: days of one source whose
    terms are joined in one task, so that the days of a hot source are as many tasks' work as it takes.
    """

    slots: int = 240
    harmonics: int = 2
    ridge: float = 1.0
    day_scale: float = 100.0
    days_a_task: int = 20_000


def epoch_seconds(tick: Column) -> Column:
    """Seconds of an epoch time in seconds, milli-, micro- or nanoseconds, told apart by magnitude."""
    size = F.abs(tick)
    return F.when(size >= 1e17, tick / 1e9).when(size >= 1e14, tick / 1e6).when(size >= 1e11, tick / 1e3).otherwise(tick)


# The first session minute less the minute of the day, by half hour; null outside of the session.
SHIFT = [-570 if 19 <= half < 23 else -660 if 26 <= half < 30 else None for half in range(48)]


def session_minute(seconds: Column) -> Column:
    """Minute of the session from epoch seconds: 09:30-11:29 are 0-119, 13:00-14:59 are 120-239, else null.

    A look-up, so that ``seconds`` is evaluated but twice however often the expression is inlined: code that grows beyond
    what the JVM compiles runs many times slower."""
    minute = F.floor(F.pmod(seconds, F.lit(86400.0)) / 60).cast("int")
    shift = F.expr(f"array({', '.join('cast(null as int)' if x is None else str(x) for x in SHIFT)})")
    return minute + F.get(shift, F.floor(minute / 30).cast("int"))


def _basis(day: Column, slot: Column, c: GridConfig) -> list[Column]:
    angle = [2 * math.pi * k / c.slots for k in range(1, c.harmonics + 1)]
    return [F.lit(1.0), (day + slot / c.slots) / c.day_scale, *[f(slot * a) for a in angle for f in (F.cos, F.sin)]]


def solve_normal(sums: np.ndarray, p: int, ridge: float) -> np.ndarray:
    """Coefficients for each row of sums: the upper triangle of X'X by rows, then X'y. The trend is centred first."""
    n = len(sums)
    upper = np.triu_indices(p)
    xx = np.zeros((n, p, p))
    xx[:, upper[0], upper[1]] = sums[:, : len(upper[0])]
    xx = xx + np.triu(xx, 1).transpose(0, 2, 1)
    xy = sums[:, len(upper[0]) :]
    centre = xx[:, 0, 1] / np.maximum(xx[:, 0, 0], 1e-300)
    shift = np.tile(np.eye(p), (n, 1, 1))
    shift[:, 0, 1] = -centre
    a = shift.transpose(0, 2, 1) @ xx @ shift
    b = np.einsum("nji,nj->ni", shift, xy)
    # The level is not penalised: terms are fitted about it.
    penalty = np.eye(p) * ridge
    penalty[0, 0] = 1e-9
    beta = np.linalg.solve(a + penalty, b[:, :, None])
    return np.einsum("nij,nj->ni", shift, beta[:, :, 0])


def day_cells(readings: DataFrame, c: GridConfig) -> DataFrame:
    """One row per (source, day) with its filled slots in order."""
    cells = readings.groupBy("source", "day", "slot").agg(F.max(F.struct("at", "y")).alias("last"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
    return cells.groupBy("source", "day").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("last.y").alias("y"), "volume", "n"))).alias("cells"))


def fitted_terms(days: DataFrame, c: GridConfig) -> DataFrame:
    """Coefficients of each source as an array, from the sums over the cells of its days, and how many days it has."""
    p = 2 + 2 * c.harmonics

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(sums: pd.Series) -> pd.Series:
        if not len(sums):
            return pd.Series([], dtype=object)
        return pd.Series(list(solve_normal(np.stack(sums.to_numpy()).astype(float), p, c.ridge)))

    cells = days.select("source", "day", F.size("cells").alias("_size"), F.explode("cells").alias("cell"))
    x = _basis(F.col("day").cast("double"), F.col("cell.slot").cast("double"), c)
    cells = cells.select("source", "day", "cell.slot", "cell.y", *[v.alias(f"x{i}") for i, v in enumerate(x)], (F.lit(1.0) / F.col("_size")).alias("_share"))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)]
    totals = cells.groupBy("source").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], F.round(F.sum("_share")).cast("long").alias("n_days"))
    return totals.select("source", solve(F.array(*[f"s{i}" for i in range(len(sums))])).alias("beta"), "n_days")


def regular_grid(readings: DataFrame, config: GridConfig = GridConfig()) -> DataFrame:
    """Rows (source, day, slot, value, volume, n_readings, filled) for every slot of each (source, day) with a reading.

    ``readings`` has columns source, day (int, days since the epoch), slot (int), at (double, orders readings of a
    slot; the last one stands, the greatest value among equal times), y (double, value to fit) and volume. Rows with
    a null in source, day, slot or y, or a slot outside the grid, are no readings. Exact duplicates should have been
    dropped, as volumes add up. A filled slot has n_readings 0 and volume 0. A source with one reading gets it in
    every slot of that day. An empty table gives no rows.
    """
    c = config
    usable = readings.where(F.col("source").isNotNull() & F.col("day").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & F.col("slot").between(0, c.slots - 1))
    days = written(day_cells(usable, c), "grid-days")
    beta = written(fitted_terms(days, c), "grid-terms")
    most = beta.agg(F.max("n_days")).first()[0] or 0
    # The terms of a source are copied as often as its own days need tasks; the most days any source has give the salt's range.
    parts = max(1, -(-most // c.days_a_task))
    copies = beta.select("source", "beta", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
    joined = days.select("source", "day", "cells", F.pmod(F.hash("day"), F.lit(parts)).alias("salt")).join(copies, ["source", "salt"])

    def predicted(slot: Column) -> Column:
        terms = _basis(F.col("day").cast("double"), slot.cast("double"), c)
        return sum((F.get("beta", F.lit(i)) * t for i, t in enumerate(terms[1:], 1)), F.get("beta", F.lit(0)) * terms[0])

    segments = joined.select("source", "day", "beta", F.size("cells").alias("size"), "cells", F.posexplode("cells").alias("i", "cell")).select(
        "source", "day", "beta", F.col("cell.slot").alias("from"), F.col("cell.y").alias("y"), F.col("cell.volume").alias("volume"), F.col("cell.n").alias("n"),
        F.get("cells", F.col("i") + 1)["slot"].alias("to"), F.get("cells", F.col("i") + 1)["y"].alias("y_to"), (F.col("i") == 0).alias("head"),
    )
    segments = segments.select("*", (F.col("y") - predicted(F.col("from"))).alias("r"), (F.col("y_to") - predicted(F.col("to"))).alias("r_to"))
    slots = segments.select(
        "*", F.explode(F.sequence(F.when(F.col("head"), F.lit(0)).otherwise(F.col("from")), F.coalesce(F.col("to") - 1, F.lit(c.slots - 1)))).alias("slot")
    )
    share = (F.col("slot") - F.col("from")) / (F.col("to") - F.col("from"))
    residual = F.when(F.col("to").isNull() | (F.col("slot") < F.col("from")), F.col("r")).otherwise(F.col("r") + (F.col("r_to") - F.col("r")) * share)
    observed = F.col("slot") == F.col("from")
    return slots.select(
        "source", "day", "slot",
        F.when(observed, F.col("y")).otherwise(predicted(F.col("slot")) + residual).alias("value"),
        F.when(observed, F.col("volume")).otherwise(F.lit(0.0)).alias("volume"),
        F.when(observed, F.col("n")).otherwise(F.lit(0)).alias("n_readings"),
        (~observed).alias("filled"),
    )
