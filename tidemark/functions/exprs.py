"""Reusable column expressions. Nulls give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def zero_if_not_finite(c: Column) -> Column:
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def rescaled(c: Column, factor: float, digits: int = 2) -> Column:
    """A fixed-point integer as a number."""
    return F.round(c.cast("double") * factor, digits)


def money_flow(close: Column, high: Column, low: Column, amount: Column) -> Column:
    """Signed share of the range at which a bar closed, times its amount."""
    return (2 * close - high - low) / (high - low + EPS) * amount


def digitize(x: Column, edges: Column) -> Column:
    """Number of edges at or below x, i.e. its bin among size(edges) + 1; null for a null x."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e <= x)))


def nearest_quantile(sorted_values: Column, q: float) -> Column:
    """Value at the nearest rank of a sorted array without nulls; null for an empty one."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, F.round((n - 1) * F.lit(q)).cast("int")))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def znorm(a: Column) -> Column:
    """(x - mean) / (population deviation + 1e-8) of an array of doubles."""

    def scaled(s: Column) -> Column:
        squares = F.aggregate(s["a"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"]))
        return _let(F.sqrt(squares / F.size(s["a"])) + EPS, lambda sd: F.transform(s["a"], lambda x: (x - s["m"]) / sd))

    return _let(F.struct(a.alias("a"), array_mean(a).alias("m")), scaled)


def windows_of(a: Column, width: int) -> Column:
    """All contiguous sub-arrays of a width, in order; none where the array is shorter."""
    return F.when(F.size(a) >= width, F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: F.slice(a, i, width))).otherwise(F.array().cast("array<array<double>>"))


def motif_threshold(m: int, r: float) -> float:
    """Z-normalised Euclidean distance of two windows of m points whose correlation is r."""
    return (2 * m * (1 - r)) ** 0.5


def volume_label(v: Column, top: Column) -> Column:
    """A tick label of an axis that ends at ``top``: all of an axis are divided by the thousands of its top, truncated, with
    one suffix; blank above 1.2 times the top. Tops of a million P and more keep the last suffix."""
    size = F.abs(top)
    step = F.when(size < 1e3, 0).when(size < 1e6, 1).when(size < 1e9, 2).when(size < 1e12, 3).when(size < 1e15, 4).otherwise(5)
    # Suffixes of powers of a thousand.
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("", "K", "M", "G", "T", "P")]), step + 1)
    scaled = v / F.pow(F.lit(1000.0), step)
    whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return F.when(v > 1.2 * top, F.lit("")).otherwise(F.concat(whole.cast("string"), suffix))


def page_of(index: Column, rows: Column, pages: int) -> Column:
    """Page of a 0-based row when rows fall into equal contiguous pages, the remainder going to the last."""
    size = F.greatest(F.floor(rows / pages), F.lit(1))
    return F.least(F.floor(index / size), F.lit(pages - 1)).cast("int")


def smooth_objective(p: Column, spread: Column, m: Column, penalty_m: float) -> Column:
    """-log10(p) * |spread| * 1e4, decaying with the excess of m over penalty_m."""
    return -F.log10(F.greatest(p, F.lit(1e-300))) * F.abs(spread) * 1e4 * F.when(m > penalty_m, F.exp(-(m - penalty_m) / 50)).otherwise(F.lit(1.0))
