"""Grouped, null-skipping Haar details, scales and runs over sorted arrays (NumPy)."""

from __future__ import annotations

import numpy as np


def neighbours(x: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the ``width`` values before and after each value, NaN skipped, within a group; NaN where there are fewer."""
    at = np.flatnonzero(~np.isnan(x))
    v, g = x[at], group[at]
    before, after = np.full(len(x), np.nan), np.full(len(x), np.nan)
    n = len(v)
    if n > width:
        same = g[width:] == g[:-width]
        mean = sum(v[i : n - width + i] for i in range(width)) / width
        ahead = sum(v[i + 1 : n - width + i + 1] for i in range(width)) / width
        before[at[width:]] = np.where(same, mean, np.nan)
        after[at[:-width]] = np.where(same, ahead, np.nan)
    return before, after


def group_median(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the values of each group, NaN skipped; NaN for a group without values."""
    keep = ~np.isnan(x)
    v, g = x[keep], group[keep]
    order = np.lexsort((v, g))
    v = v[order]
    n = np.bincount(g, minlength=groups)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.full(groups, np.nan)
    some = n > 0
    out[some] = (v[(start + (n - 1) // 2)[some]] + v[(start + n // 2)[some]]) / 2
    return out


def runs(x: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each value the length of the run of equal values it lies in (0 for NaN) and whether it begins it; for each
    group the number of values and of runs longer than one."""
    at = np.flatnonzero(~np.isnan(x))
    v, g = x[at], group[at]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    run = np.cumsum(first) - 1
    size = np.bincount(run, minlength=1)
    length, begins = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    length[at] = size[run]
    begins[at] = first
    return length, begins, np.bincount(g, minlength=groups), np.bincount(g[first & (size[run] > 1)], minlength=groups)


def excursions(x: np.ndarray, group: np.ndarray, longest: int, least: np.ndarray) -> np.ndarray:
    """Values of runs of at most ``longest`` that all stand off by more than ``least``, in one direction, from the value
    before the run and the one after it, while these two are no further apart than ``least``; NaN skipped, within a group."""
    at = np.flatnonzero(~np.isnan(x))
    out = np.zeros(len(x), bool)
    n = len(at)
    if n < 3:
        return out
    v, g, far = x[at], group[at], least[at]
    # Runs that begin with a large step and may end with one; few, so lengths are tried on these alone.
    begin = np.flatnonzero((np.abs(v[1:] - v[:-1]) > far[1:]) & (g[1:] == g[:-1])) + 1
    low, high = v[begin], v[begin]
    for size in range(1, longest + 1):
        inside = (begin + size < n) & (g[np.minimum(begin + size, n - 1)] == g[begin])
        begin, low, high = begin[inside], low[inside], high[inside]
        before, after = v[begin - 1], v[begin + size]
        back = np.abs(after - before) <= far[begin]
        off = back & ((low - np.maximum(before, after) > far[begin]) | (np.minimum(before, after) - high > far[begin]))
        for i in range(size):
            out[at[begin[off] + i]] = True
        low, high = np.minimum(low, after), np.maximum(high, after)
    return out
